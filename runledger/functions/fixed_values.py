"""These must be exactly what they are for results to be right.

Every table below is plain data.  Nothing in here reads or writes anything.
"""

# --- fixed values: file category by lower-cased suffix; anything else is "other"
CATEGORY_EXTENSIONS = {
    "dataset": [".csv", ".parquet", ".jsonl", ".tsv", ".feather"],
    "model": [".pt", ".pth", ".onnx", ".joblib", ".pkl", ".safetensors", ".ckpt"],
    "notebook": [".ipynb"],
    "config": [".yaml", ".yml", ".json", ".toml", ".ini"],
    "script": [".py", ".sh", ".bash"],
    "doc": [".md", ".rst", ".txt"],
    "image": [".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp"],
    "log": [".log", ".out"],
}

# --- fixed values: model framework by lower-cased suffix; anything else is "unknown"
FRAMEWORK_EXTENSIONS = {
    "pytorch": [".pt", ".pth", ".ckpt"],
    "tensorflow": [".pb", ".savedmodel"],
    "onnx": [".onnx"],
    "sklearn": [".joblib", ".pkl"],
    "safetensors": [".safetensors"],
}

# --- fixed values: lineage artifact type by lower-cased suffix; anything else is "artifact"
ARTIFACT_EXTENSIONS = {
    "dataset": [".csv", ".parquet", ".jsonl", ".tsv", ".feather"],
    "model": [".pt", ".pth", ".ckpt", ".onnx", ".joblib", ".pkl", ".safetensors"],
    "config": [".yaml", ".yml", ".json", ".toml"],
    "image": [".png", ".jpg", ".jpeg", ".svg"],
    "text": [".txt", ".md", ".log"],
}

# --- fixed values: suffixes that count as a model file when no registry exists
MODEL_EXTENSIONS = [".pt", ".pth", ".ckpt", ".onnx", ".joblib", ".pkl", ".safetensors"]

# --- fixed values: suffixes the keep-newest rule looks at
CHECKPOINT_EXTENSIONS = [".pt", ".pth", ".ckpt", ".onnx", ".safetensors"]

# --- fixed values: what project retention removes
REMOVABLE_DIRS = ["__pycache__", ".ipynb_checkpoints", "wandb", "lightning_logs"]
REMOVABLE_NAMES = [".DS_Store"]
REMOVABLE_SUFFIXES = [".pyc", ".tmp", ".log"]

# --- fixed values: top-level modules that do not count as third-party imports
STDLIB_MODULES = [
    "abc", "argparse", "ast", "asyncio", "collections", "contextlib", "csv", "dataclasses",
    "datetime", "functools", "glob", "hashlib", "itertools", "json", "logging", "math", "os",
    "pathlib", "random", "re", "shutil", "string", "subprocess", "sys", "tempfile", "time",
    "typing", "statistics", "unittest", "uuid",
]

# --- fixed values: directories and files every project layout must have
LAYOUTS = {
    "basic_ml": {
        "dirs": ["data/raw", "data/processed", "models", "notebooks", "src", "configs", "reports", "tests"],
        "files": ["README.md", "configs/train.yaml", "src/__init__.py"],
    },
    "deep_learning": {
        "dirs": ["data/raw", "data/processed", "models/checkpoints", "models/exports", "notebooks",
                 "src/data", "src/models", "src/training", "configs", "logs", "tests"],
        "files": ["README.md", "configs/model.yaml", "src/__init__.py"],
    },
    "nlp": {
        "dirs": ["data/raw", "data/tokenized", "models", "notebooks", "src/preprocessing", "src/training",
                 "configs", "reports", "tests"],
        "files": ["README.md", "configs/tokenizer.yaml", "src/__init__.py"],
    },
    "computer_vision": {
        "dirs": ["data/images", "data/labels", "models", "notebooks", "src/datasets", "src/models",
                 "src/training", "configs", "tests"],
        "files": ["README.md", "configs/augmentations.yaml", "src/__init__.py"],
    },
    "time_series": {
        "dirs": ["data/raw", "data/features", "models", "notebooks", "src/features", "src/training",
                 "configs", "reports", "tests"],
        "files": ["README.md", "configs/features.yaml", "src/__init__.py"],
    },
    "mlops_pipeline": {
        "dirs": ["data/raw", "data/processed", "pipelines", "models", "src/pipelines", "src/training",
                 "configs", "deploy", "tests"],
        "files": ["README.md", "pipelines/pipeline.yaml", "src/__init__.py"],
    },
    "llm_finetuning": {
        "dirs": ["data/raw", "data/formatted", "models/checkpoints", "models/merged", "src/data",
                 "src/training", "src/evaluation", "configs", "tests"],
        "files": ["README.md", "configs/finetune.yaml", "src/__init__.py"],
    },
}

# --- fixed values: limits and thresholds
KS_ALPHA = 0.05
FREQUENCY_DISTANCE_LIMIT = 0.2

# --- fixed values: line ends a text is split at (CRLF counts once)
LINE_BREAK_PATTERN = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"

# --- fixed values: type names of a contract for each Spark type
CONTRACT_TYPE_NAMES = {
    "tinyint": ["int8"],
    "smallint": ["int16"],
    "int": ["int32"],
    "bigint": ["int64"],
    "float": ["float32"],
    "double": ["float64"],
    "boolean": ["bool"],
    "string": ["object", "str"],
    "timestamp": ["datetime64[ns]", "datetime64[us]"],
    "timestamp_ntz": ["datetime64[ns]", "datetime64[us]"],
}

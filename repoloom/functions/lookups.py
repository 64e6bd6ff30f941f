"""Fixed lookup values and the small dimension tables made of them.

The tables have a fixed number of rows (below 200), so broadcasting them is safe
at any corpus size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Markdown language tag of special file names (ignore case).
LANGUAGE_BY_NAME = {
    "Dockerfile": "docker",
    "Makefile": "makefile",
    "Doxyfile": "ini",
    "CMakeLists.txt": "cmake",
    "Jenkinsfile": "groovy",
    "Gemfile": "ruby",
    "Rakefile": "ruby",
    "Vagrantfile": "ruby",
    "Podfile": "ruby",
    "Fastfile": "ruby",
    "Brewfile": "ruby",
}

# Markdown language tag of extensions (ignore case).
LANGUAGE_BY_EXTENSION = {
    ".c": "c",
    ".h": "c",
    ".cpp": "cpp",
    ".cc": "cpp",
    ".cxx": "cpp",
    ".hpp": "cpp",
    ".hh": "cpp",
    ".cs": "csharp",
    ".csproj": "xml",
    ".vbproj": "xml",
    ".fsproj": "xml",
    ".vcxproj": "xml",
    ".resx": "xml",
    ".config": "xml",
    ".props": "xml",
    ".targets": "xml",
    ".xml": "xml",
    ".java": "java",
    ".kt": "kotlin",
    ".kts": "kotlin",
    ".groovy": "groovy",
    ".scala": "scala",
    ".js": "javascript",
    ".mjs": "javascript",
    ".cjs": "javascript",
    ".jsx": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".vue": "vue",
    ".svelte": "svelte",
    ".html": "html",
    ".htm": "html",
    ".css": "css",
    ".scss": "scss",
    ".sass": "sass",
    ".less": "less",
    ".py": "python",
    ".rb": "ruby",
    ".php": "php",
    ".go": "go",
    ".rs": "rust",
    ".swift": "swift",
    ".lua": "lua",
    ".dart": "dart",
    ".pl": "perl",
    ".r": "r",
    ".gd": "gdscript",
    ".shader": "glsl",
    ".glsl": "glsl",
    ".hlsl": "hlsl",
    ".fs": "fsharp",
    ".fsx": "fsharp",
    ".elm": "elm",
    ".clj": "clojure",
    ".json": "json",
    ".yml": "yaml",
    ".yaml": "yaml",
    ".toml": "toml",
    ".ini": "ini",
    ".cfg": "ini",
    ".editorconfig": "ini",
    ".gitmodules": "ini",
    ".npmrc": "ini",
    ".coveragerc": "ini",
    ".csv": "csv",
    ".sql": "sql",
    ".sh": "bash",
    ".bash": "bash",
    ".zsh": "bash",
    ".env": "bash",
    ".ps1": "powershell",
    ".bat": "batch",
    ".md": "markdown",
    ".sln": "plaintext",
    ".txt": "plaintext",
    ".log": "plaintext",
    ".dockerfile": "docker",
    ".gitignore": "gitignore",
    ".gitattributes": "gitignore",
}

# Extensions of binary files (ignore case).
BINARY_EXTENSIONS = {
    ".zip", ".rar", ".7z", ".tar", ".gz", ".tgz", ".bz2", ".xz", ".lz", ".lz4", ".lzma", ".zst",
    ".cab", ".jar", ".war", ".ear", ".nupkg", ".snupkg", ".vsix", ".whl", ".exe", ".dll", ".so",
    ".dylib", ".bin", ".msi", ".app", ".deb", ".rpm", ".com", ".scr", ".sys", ".drv", ".ocx",
    ".appx", ".appxbundle", ".msix", ".msixbundle", ".apk", ".ipa", ".o", ".obj", ".a", ".lib",
    ".class", ".pyc", ".pyo", ".pyd", ".pdb", ".ilk", ".idb", ".pch", ".ipch", ".wasm", ".dex",
    ".doc", ".docx", ".docm", ".xls", ".xlsx", ".xlsm", ".ppt", ".pptx", ".pptm", ".mp3", ".wav",
    ".flac", ".aac", ".ogg", ".m4a", ".wma", ".mp4", ".avi", ".mov", ".mkv", ".webm", ".flv",
    ".wmv", ".mpeg", ".mpg", ".m4v", ".3gp", ".ttf", ".otf", ".woff", ".woff2", ".eot", ".sqlite",
    ".sqlite3", ".db", ".db3", ".mdb", ".accdb", ".sdf", ".parquet", ".psd", ".ai", ".sketch",
    ".fig", ".iso", ".dmg",
}

# Extensions of exportable images and of PDF files (ignore case).
IMAGE_EXTENSIONS = {".png", ".jpg", ".jpeg", ".gif", ".bmp", ".webp", ".svg", ".ico"}
PDF_EXTENSION = ".pdf"

# Prefix of environment files, their language, the default language.
DOTENV_PREFIX = ".env"
DOTENV_LANGUAGE = "bash"
DEFAULT_LANGUAGE = "plaintext"

# Files of this many bytes or more are "large"; bytes sniffed for
# binary content; share of control bytes (percent) above which content is binary;
# bytes searched for a declared charset.
LARGE_FILE_BYTES = 1_048_576
SNIFF_BYTES = 4096
SNIFF_PERCENT = 30
CHARSET_BYTES = 8192


def extension_dim(spark: SparkSession) -> DataFrame:
    """One row per known extension: its language tag and its classes."""
    rows = [
        (ext, LANGUAGE_BY_EXTENSION.get(ext), ext in LANGUAGE_BY_EXTENSION, ext in BINARY_EXTENSIONS, ext in IMAGE_EXTENSIONS, ext == PDF_EXTENSION)
        for ext in sorted({*LANGUAGE_BY_EXTENSION, *BINARY_EXTENSIONS, *IMAGE_EXTENSIONS, PDF_EXTENSION})
    ]
    return spark.createDataFrame(
        rows,
        "ext string, ext_language string, ext_text boolean, ext_binary boolean, ext_image boolean, ext_pdf boolean",
    )


def file_name_dim(spark: SparkSession) -> DataFrame:
    """One row per special file name, lower case, with its language tag."""
    return spark.createDataFrame([(k.lower(), v) for k, v in LANGUAGE_BY_NAME.items()], "name_key string, name_language string")

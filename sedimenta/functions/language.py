"""Languages of files, by name or by content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sedimenta.functions import paths

# Extensions that are indexed, and their languages.
LANGUAGES = {
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".cts": "typescript",
    ".py": "python", ".pyw": "python", ".pyi": "python", ".java": "java", ".kt": "kotlin", ".kts": "kotlin", ".scala": "scala", ".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp",
    ".cc": "cpp", ".hh": "cpp", ".cxx": "cpp", ".cs": "csharp", ".go": "go", ".rs": "rust", ".rb": "ruby", ".php": "php", ".swift": "swift", ".sh": "shell", ".bash": "shell", ".zsh": "shell",
    ".html": "html", ".htm": "html", ".css": "css", ".scss": "scss", ".sass": "sass", ".less": "less", ".vue": "vue", ".svelte": "svelte", ".json": "json", ".yaml": "yaml", ".yml": "yaml",
    ".toml": "toml", ".xml": "xml", ".ini": "ini", ".cfg": "ini", ".md": "markdown", ".mdx": "markdown", ".rst": "restructuredtext", ".txt": "plaintext", ".sql": "sql", ".dart": "dart",
    ".lua": "lua", ".r": "r", ".ex": "elixir", ".exs": "elixir", ".gd": "gdscript", ".tscn": "godot-resource", ".tres": "godot-resource", ".styl": "stylus", ".heex": "elixir", ".eex": "elixir", ".leex": "elixir", ".dockerfile": "dockerfile",
}
SPECIAL_NAMES = ("Dockerfile", "Makefile", "Rakefile", "Gemfile", "Procfile", ".env.example", ".gitignore", ".dockerignore")
# Interpreters of shebang lines.
INTERPRETERS = {"python": ".py", "node": ".js", "deno": ".ts", "bun": ".ts", "sh": ".sh", "bash": ".sh", "zsh": ".sh", "dash": ".sh", "ksh": ".sh", "ash": ".sh", "nodejs": ".js", "ruby": ".rb", "php": ".php", "lua": ".lua"}
# Signs of a language in the head of a file without extension.
PYTHON_SIGNS = (
    r"(?m)^from\s+\.*(?:[A-Za-z_][\w.]*)?\s+import\s", r"(?m)^import\s+[A-Za-z_][\w.]*(?:\s*,\s*[A-Za-z_][\w.]*)*\s*$",
    r"(?m)^\s*def\s+\w+\s*\([^)]*\)\s*(?:->[^:]+)?:", r"(?m)^\s*class\s+\w+(?:\([^)]*\))?\s*:",
)
SHELL_SIGNS = (
    r"(?m)^\s*set\s+-[euxo]", r"(?m)^\s*if\s+\[\[?\s.*\]\]?\s*;\s*then\b", r"(?m)^\s*(?:fi|esac|done)\s*$", r"(?m)^\s*function\s+\w+",
    r"(?m)^\s*\w+\s*\(\)\s*\{", r"\$\{?\d|\$\{[A-Za-z_]",
)


def language_of(path: Column, extra: dict[str, str] | None = None) -> Column:
    """The language of a path's extension; extra maps further extensions to known ones; all else is plaintext."""
    table = LANGUAGES | {k.lower(): LANGUAGES.get(v.lower(), "plaintext") for k, v in (extra or {}).items()}
    found = F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), paths.extension(path))
    return F.coalesce(found, F.lit("plaintext"))


def is_indexable(path: Column, extra: tuple[str, ...] = ()) -> Column:
    return paths.extension(path).isin(*LANGUAGES, *(e.lower() for e in extra)) | paths.base(path).isin(*SPECIAL_NAMES)


def sniffed_extension(head: Column) -> Column:
    """The extension that the head of a file without one stands for: by its shebang (an unknown interpreter means .txt), else by signs of
    python or shell; null for binaries and where nothing speaks for either."""
    line = F.regexp_extract(head, r"^#!([^\n]*)", 1)
    line = F.regexp_replace(line, r"(\bnice\b(?:\s+-\S+)*?)\s+-n\s+\S+|(\b(?:sudo|doas|env)\b(?:\s+-\S+)*?)\s+-u\s+\S+", "$1$2")
    words = F.filter(F.split(line, r"\s+"), lambda w: (w != "") & ~w.rlike(r"(?:^|/)(?:env|nice|sudo|doas|time|with-contenv)$") & ~w.startswith("-") & ~w.contains("="))
    program = F.regexp_replace(paths.base(F.coalesce(F.get(words, F.lit(0)), F.lit(""))), r"[\d.]+$", "")
    shebang = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in INTERPRETERS.items() for x in kv)), program), F.lit(".txt"))
    hits = lambda signs: sum((head.rlike(s).cast("int") for s in signs), F.lit(0))
    python, shell = hits(PYTHON_SIGNS), hits(SHELL_SIGNS)
    guess = F.when((python >= 1) & (python >= shell), ".py").when(shell >= 2, ".sh")
    return F.when(F.instr(head, "\x00") > 0, None).when(F.startswith(head, F.lit("#!")), shebang).otherwise(guess)

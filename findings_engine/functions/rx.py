"""Regular expressions and word lists, in Java's dialect with Unicode classes and boundaries.

``(?U)`` makes \\w, \\d, \\s and \\b Unicode-aware; classes that are written out
stay ASCII on purpose.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Results are only right if these equal the published grammar,
# so they stand here as they are there, in the same order.
# ---------------------------------------------------------------------------

STATUS = r"(?iU)\bSTATUS:\s*(OPEN|CLOSED|REOPENED|PARTIAL|WITHDRAWN|DOWNGRADED)\b"
SEVERITY = r"(?iU)\bSEVERITY:\s*(CRITICAL|HIGH|MEDIUM|LOW)\b"
SEVERITIES = ("critical", "high", "medium", "low")
#: Words that tell a status without the explicit grammar; the first entry that occurs in a heading decides.
STATUS_WORDS = (
    ("withdrawn", r"(?iU)\b(?:WITHDRAWN|RETRACTED)\b"),
    ("open", r"(?iU)\b(?:REOPENED|UNRESOLVED)\b"),
    ("partial", r"(?iU)\b(?:PARTIALLY\s+CLOSED|PARTIAL)\b"),
    ("downgraded", r"(?iU)\bDOWNGRADED\b"),
    ("closed", r"(?iU)\b(?:CLOSED|RESOLVED|FIXED)\b"),
)
HEADING = r"#{2,6} "
ID_STYLE = r"(?U)^#{2,6}\s+([A-Za-z][A-Za-z0-9_]*(?:-[A-Za-z][A-Za-z0-9_]*)*)-?(\d+)\b"

CODE_SPAN = r"`([^`\n]{2,80})`"
WORD = r"[A-Za-z_][A-Za-z0-9_]*"
SNAKE = r"(?U)\b(_?[a-z][a-z0-9_]*)\b"
CAMEL = r"(?U)\b([A-Z][A-Za-z0-9]+)\b"
DOTTED = r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+"
SYNTAX_PREFIX = r"^(?:(?:self|cls|this)\.)+"
FILE_TOKEN = r"(?U)^(?:(?:\([\w.\-]+\)|\[[\w.\-]+\]|[\w.\-]+)/)*[\w.\-]*\w\.[A-Za-z0-9][\w\-]*$"
FILE_BARE = (
    r"(?U)(?<![\w./\\-])((?:(?:\([\w.\-]+\)|\[[\w.\-]+\]|[\w.\-]+)/)+[\w.\-]*\w\.[A-Za-z0-9][\w\-]*)"
)
FILE_EXTENSIONS = (
    "py", "pyi", "js", "jsx", "ts", "tsx", "mjs", "cjs", "md", "json", "yml", "yaml", "toml", "ini", "cfg", "txt",
    "sh", "bash", "go", "rs", "java", "rb", "c", "h", "cc", "cpp", "hpp", "cs", "php", "html", "css", "scss", "sql",
    "xml", "lock", "csv",
)
#: Names too common to point at anything.
STOPWORDS = (
    "data", "value", "values", "result", "results", "config", "settings", "status", "content", "context", "request",
    "response", "record", "records", "session", "message", "options", "params", "output", "input", "index", "update",
    "create", "delete", "select", "insert", "filter", "process", "handler", "manager", "service", "client", "server",
    "public", "private", "string", "number", "object", "array", "table", "column", "schema", "severity", "sections",
    "related", "title", "notes",
)
FRONTMATTER = r"(?s)\A---\n(.*?)\n---\n"
OLD_BLOCK = r"(?m)^## Linked code\n\n(?:- .*\n)*\n?"
RELATED_LINE = r"(?m)^Related: .*$"
#: Extension -> definition at the start of a line, the name in group 1.
DEFINITIONS = {
    "py": r"(?U)^\s*(?:async\s+)?(?:def|class)\s+([A-Za-z_]\w*)",
    "js": r"(?U)^\s*(?:(?:export\s+(?:default\s+)?)?(?:async\s+)?(?:function|class)|export\s+(?:const|let|var))\s+([A-Za-z_$]\w*)",
    "ts": r"(?U)^\s*(?:(?:export\s+(?:default\s+)?)?(?:abstract\s+)?(?:async\s+)?(?:function|class|interface|type|enum)|export\s+(?:const|let|var)(?:\s+enum)?)\s+([A-Za-z_$]\w*)",
    "tsx": r"(?U)^\s*(?:(?:export\s+(?:default\s+)?)?(?:async\s+)?(?:function|class|interface|type)|export\s+(?:const|let|var)(?:\s+enum)?)\s+([A-Za-z_$]\w*)",
    "go": r"(?U)^\s*(?:func|type)\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)",
    "rs": r"(?U)^\s*(?:pub\s+)?(?:async\s+)?(?:fn|struct|enum|trait|impl)\s+([A-Za-z_]\w*)",
    "java": r"(?U)^\s*(?:public|private|protected|static|final|abstract|\s)*(?:class|interface|enum|record)\s+([A-Za-z_]\w*)",
    "rb": r"(?U)^\s*(?:def|class|module)\s+([A-Za-z_][\w?!]*)",
    "php": r"(?U)^\s*(?:abstract\s+|final\s+)?(?:function|class|trait|interface)\s+([A-Za-z_]\w*)",
    "c": r"(?U)^[A-Za-z_][\w\s\*]*\s+\*?([A-Za-z_]\w*)\s*\([^;]*$",
    "h": r"(?U)^[A-Za-z_][\w\s\*]*\s+\*?([A-Za-z_]\w*)\s*\([^;]*$",
    "cpp": r"(?U)^\s*(?:class|struct)\s+([A-Za-z_]\w*)",
    "sql": r"(?iU)^\s*create\s+(?:or\s+replace\s+)?(?:table|view|function|index|materialized\s+view)\s+(?:if\s+not\s+exists\s+)?[\"`\[]?([A-Za-z_]\w*)",
}
SKIP_DIRS = (
    ".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", ".mypy_cache", ".pytest_cache", "vendor",
    "target", ".next", "graphify-out",
)

# ---------------------------------------------------------------------------
# Our own.
# ---------------------------------------------------------------------------

#: Any line break, for texts; CRLF, CR and LF only, for files of source code.
LINES, FILE_LINES = r"\R", r"\r\n|\r|\n"
IDENT = f"^{WORD}$"
CHAIN = rf"(?U)\b{DOTTED}\b"
MARK_START, MARK_END = "<!-- findings:code:start -->", "<!-- findings:code:end -->"
MANAGED = rf"(?s)\Q{MARK_START}\E.*?\Q{MARK_END}\E\n*"


def quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def finding_id(prefix: str) -> str:
    """An id: the prefix, a hyphen or none, digits; no boundaries."""
    return quoted(prefix) + r"-?\d+"

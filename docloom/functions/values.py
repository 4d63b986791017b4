"""Word lists, patterns and constants that define results. Patterns are those of JavaScript, ASCII classes."""

# Extensions by kind of content.
CODE_EXT = "js ts jsx tsx py java c cpp h hpp cs go rs php rb swift kt scala clj sh bash zsh ps1 bat cmd".split()
DOCS_EXT = "md txt rst adoc tex org".split()
CONFIG_EXT = "json yaml yml toml ini cfg conf xml plist properties env dockerfile".split()
SUPPORTED_EXT = "txt md json yaml yml rst js ts py java c cpp h css scss html xml csv".split()

# Language of an extension.
EXT_LANGUAGE = {"js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "py": "python", "java": "java", "c": "c", "cpp": "cpp", "h": "c", "hpp": "cpp", "cs": "csharp", "go": "go", "rs": "rust", "php": "php", "rb": "ruby", "sh": "shell", "bash": "shell", "zsh": "shell"}
CONFIG_LANGUAGE = {"json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "xml": "xml", "ini": "ini", "cfg": "ini", "conf": "ini"}

# Patterns of a language, in order of evaluation.
LANGUAGE_PATTERNS = {
    "javascript": [r"\b(?:function|const|let|var|=>|async|await)\b", r"\bimport\s+[^\n]*\bfrom\b", r"\brequire\s*\("],
    "typescript": [r"\binterface\b", r"\btype\s+\w+\s*=", r":\s*\w+(?:\[\])?(?:\s*\|\s*\w+(?:\[\])?)*\s*[;,=]"],
    "python": [r"\bdef\s+\w+\s*\(", r"\bimport\s+\w+", r"\bfrom\s+\w+\s+import\b", r"\bclass\s+\w+:"],
    "java": [r"\bpublic\s+class\b", r"\bprivate\s+\w+", r"\bimport\s+[\w.]+;", r"\bpublic\s+static\s+void\s+main\b"],
    "cpp": [r"\b#include\s*<", r"\bstd::\w+", r"\bnamespace\s+\w+", r"\bclass\s+\w+\s*\{"],
    "csharp": [r"\busing\s+\w+;", r"\bnamespace\s+\w+", r"\bpublic\s+class\s+\w+"],
    "go": [r"\bpackage\s+\w+", r"\bfunc\s+\w+\s*\(", r"\bimport\s+\("],
    "rust": [r"\bfn\s+\w+\s*\(", r"\buse\s+\w+::", r"\bstruct\s+\w+", r"\bimpl\s+\w+"],
    "php": [r"\b<\?php\b", r"\bfunction\s+\w+\s*\(", r"\bclass\s+\w+"],
    "ruby": [r"\bdef\s+\w+", r"\bclass\s+\w+", r"\brequire\s+['\"]", r"\bend\b"],
    "shell": [r"\b#!", r"\bif\s+\[", r"\becho\s+", r"\bexport\s+\w+="],
    "sql": [r"\bSELECT\s+", r"\bFROM\s+\w+", r"\bWHERE\s+", r"(?i)\bINSERT\s+INTO\b"],
    "html": [r"<html\b", r"<div\b", r"<script\b", r"<style\b"],
    "css": [r"\{[^}]*\}", r"\.[a-zA-Z-]+\s*\{", r"@media\s*\("],
    "yaml": [r"^\s*\w+:\s*", r"^\s*-\s+", r"(?m)^\s*---\s*$"],
    "json": [r"^\s*\{", r"^\s*\[", r"\"[\w-]+\"\s*:\s*"],
}

# Patterns whose matches are counted for a score.
CODE_SCORE = [r"\bfunction\s+\w+\s*\(", r"\bclass\s+\w+", r"\bimport\s+", r"\bif\s*\(", r"\bfor\s*\(", r"\bwhile\s*\(", r"[{}();]", r"\b(?:const|let|var|def|public|private|protected)\b"]
DOCS_SCORE = [r"(?m)^#+\s+", r"\*\*[^\n]*?\*\*", r"\[[^\n]*?\]\([^\n]*?\)", r"(?m)^\s*[-*+]\s+", r"(?m)^\s*\d+\.\s+", r"```[\s\S]*?```", r"`[^`]+`"]
CONFIG_SCORE = [r"(?m)^\s*[\w-]+\s*[:=]", r"(?m)^\s*\[[^\n]*\]\s*$", r"(?m)^\s*\{[\s\S]*\}$", r"(?m)^\s*-\s+", r"<[\w-]+[^>]*>"]
COMMENT_PATTERNS = [r"/\*[\s\S]*?\*/", r"//[^\n]*", r"#[^\n]*", r"<!--[\s\S]*?-->", r'"""[\s\S]*?"""', r"'''[\s\S]*?'''"]
DOC_KEYWORDS = ["@param", "@return", "@throws", "TODO:", "FIXME:", "NOTE:", "WARNING:"]
STRUCTURE_PATTERNS = [r"\bfunction\s+\w+", r"\bclass\s+\w+", r"\bdef\s+\w+", r"(?m)^\s*/\*\*[\s\S]*?\*/"]

# Markers of authority in a path and in contents.
PATH_MARKERS = ["docs.", "documentation", "official", "reference", "guide", "tutorial", "readme", "manual", "specification", "spec", "api"]
CONTENT_MARKERS = ["copyright", "license", "official", "documentation", "specification"]
GENERATED_MARKERS = ["generated", "auto-generated", "automatically generated", "do not edit", "autogenerated", "build output"]
URL_PATTERNS = [r"https?://[a-zA-Z0-9.-]+\.(?:org|edu|gov)", r"https?://docs\.", r"https?://[a-zA-Z0-9.-]+/docs?/"]

# The vocabulary at first start: domain, boost, keywords with weights, authority sites.
VOCABULARY = [
    ("javascript", 1.2, {"javascript": 1.0, "js": 0.9, "node": 0.8, "npm": 0.8, "ES6": 0.7, "async": 0.6, "await": 0.6, "promise": 0.7}, ["developer.mozilla.org", "nodejs.org", "javascript.info"]),
    ("web-frameworks", 1.5, {"express": 1.0, "expressjs": 1.0, "react": 1.0, "vue": 1.0, "angular": 1.0, "middleware": 0.8, "router": 0.7, "component": 0.6}, ["expressjs.com", "reactjs.org", "vuejs.org", "angular.io"]),
    ("python", 1.2, {"python": 1.0, "pip": 0.8, "django": 0.9, "flask": 0.9, "import": 0.6, "def": 0.5, "class": 0.5}, ["python.org", "docs.python.org", "pypi.org"]),
    ("databases", 1.3, {"sql": 1.0, "database": 0.9, "mongodb": 0.9, "postgres": 0.9, "mysql": 0.9, "sqlite": 0.8, "query": 0.7, "schema": 0.7}, ["postgresql.org", "mysql.com", "mongodb.com", "sqlite.org"]),
]

# Evidence of a domain in a path and by language.
PATH_DOMAINS = {"javascript": ["js", "node", "npm"], "web-frameworks": ["express", "react", "vue", "angular", "next", "nuxt"], "python": ["python", "py", "pip", "django", "flask"], "databases": ["db", "database", "sql", "mongo", "postgres", "mysql"], "devops": ["docker", "k8s", "kubernetes", "ci", "cd", "deploy"], "testing": ["test", "spec", "__tests__", "cypress", "jest"]}
LANGUAGE_DOMAINS = {"javascript": ["javascript", "web-frameworks"], "typescript": ["javascript", "web-frameworks"], "python": ["python"], "java": ["java", "enterprise"], "csharp": ["dotnet", "enterprise"], "go": ["go", "backend"], "rust": ["rust", "systems"], "php": ["php", "web-frameworks"], "ruby": ["ruby", "web-frameworks"], "shell": ["devops", "automation"], "sql": ["databases"], "yaml": ["devops", "configuration"], "json": ["configuration", "api"], "html": ["web-frontend"], "css": ["web-frontend"]}
IMPORT_PATTERNS = [r"import\s+[^\n]*?['\"`]([^'\"`]+)['\"`]", r"require\s*\(\s*['\"`]([^'\"`]+)['\"`]\s*\)", r"from\s+['\"`]([^'\"`]+)['\"`]"]

# Terms that are never removed from a query, and words that stand for each other.
ESSENTIAL_TERMS = "function class method variable import export async await return const let var".split()
SYNONYMS = {"function": ["method", "func"], "class": ["object", "instance"], "variable": ["var", "const", "let"], "import": ["require", "module"], "async": ["await", "promise"]}

# Terms marked in documents and collected from configuration.
KEY_TERMS = "API function method class interface parameter return example usage installation configuration setup".split()
CONFIG_TERMS = [r"\b(?:server|port|host|database|username|password|timeout|retry|ssl|tls|cert)\b", r"\b(?:api_key|secret|token|auth|login|session|cookie)\b", r"\b(?:memory|cpu|disk|storage|cache|buffer|pool)\b"]
COMMENTS_OF = {
    "slash": [r"//\s*([^\n]+)", r"/\*\s*([\s\S]*?)\s*\*/", r"/\*\*\s*([\s\S]*?)\s*\*/"],
    "python": [r"#\s*([^\n]+)", r'"""\s*([\s\S]*?)\s*"""', r"'''\s*([\s\S]*?)\s*'''"],
    "shell": [r"#\s*([^\n]+)"],
    "markup": [r"<!--\s*([\s\S]*?)\s*-->"],
}
COMMENT_KIND = {"javascript": "slash", "typescript": "slash", "java": "slash", "cpp": "slash", "csharp": "slash", "python": "python", "shell": "shell", "html": "markup", "xml": "markup"}
DOC_FLAGS = [r"(?i)@param\b", r"(?i)@return\b", r"(?i)@throws\b", r"(?i)@author\b", r'"""[\s\S]*?"""', r"'''[\s\S]*?'''", r"/\*\*[\s\S]*?\*/", r"(?i)TODO:", r"(?i)FIXME:", r"(?i)NOTE:"]
MOJIBAKE = [("â€™", "'"), ("â€œ", '"'), ("â€", '"'), ("Ã¡", "á"), ("Ã©", "é"), ('â€"', "—")]

# Error texts that mean a repository can't be read directly.
ACCESS_ERRORS = ["401", "403", "404", "authentication", "permission", "access denied", "credential", "unauthorized"]
REPO_INCLUDE = ["**/*.md", "**/*.mdx", "**/*.txt", "**/*.json", "**/*.rst", "**/*.yml", "**/*.yaml"]
REPO_EXCLUDE = ["**/node_modules/**", "**/.git/**", "**/__pycache__/**", "**/*.pyc", "**/dist/**", "**/build/**", "**/.DS_Store", "**/Thumbs.db"]

# Learning.
HISTORY, EWMA_ALPHA, EWMA_WINDOW, VARIANCE_WINDOW = 1000, 0.1, 20, 30
RATE_START, RATE_MIN, RATE_MAX, RATE_STEP = 0.05, 0.01, 0.1, 0.01
THRESHOLD_START, THRESHOLD_MIN, THRESHOLD_MAX, THRESHOLD_STEP = 0.25, 0.1, 0.5, 0.02
WEIGHT_MIN, WEIGHT_MAX, WEIGHT_STEP = 0.1, 3.0, 0.1
STRATEGIES = ["removal", "refinement", "contextual_addition"]

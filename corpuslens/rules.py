"""Fixed values.

Everything in this file is a literal table: lookup maps, word lists, limits and
regular expressions whose values define the results.  They are data, not logic.
Regular expressions are written in Java syntax without flags; the operators add
the flags they need (see ``functions.text``).
"""

# --- directories that are never entered, by profile (besides hidden ones) -------------------
PRUNED_DIRS = {
    "P1": ["node_modules", "venv", "__pycache__"],
    "P2": ["node_modules", "venv"],
    "P3": ["node_modules", "venv", "__pycache__", "dist", "build"],
    "P4": ["node_modules"],
}

# --- extension -> language -------------------------------------------------------------------
LANGUAGE_BY_EXTENSION = {
    ".py": "Python",
    ".js": "JavaScript",
    ".jsx": "JavaScript",
    ".ts": "TypeScript",
    ".tsx": "TypeScript",
    ".java": "Java",
    ".c": "C",
    ".cpp": "C++",
    ".h": "C",
    ".hpp": "C++",
    ".go": "Go",
    ".rs": "Rust",
    ".cs": "C#",
    ".php": "PHP",
    ".rb": "Ruby",
    ".kt": "Kotlin",
    ".kts": "Kotlin",
    ".swift": "Swift",
    ".dart": "Dart",
    ".scala": "Scala",
    ".lua": "Lua",
    ".sh": "Shell",
    ".bash": "Shell",
    ".zsh": "Shell",
    ".r": "R",
    ".m": "Objective-C",
    ".mm": "Objective-C",
    ".pl": "Perl",
    ".pm": "Perl",
    ".hs": "Haskell",
    ".ex": "Elixir",
    ".exs": "Elixir",
    ".erl": "Erlang",
    ".clj": "Clojure",
    ".cljs": "Clojure",
    ".sql": "SQL",
    ".yaml": "YAML",
    ".yml": "YAML",
    ".json": "JSON",
    ".xml": "XML",
    ".toml": "TOML",
    ".md": "Markdown",
    ".html": "HTML",
    ".css": "CSS",
    ".scss": "SCSS",
    ".less": "LESS",
    ".vue": "Vue",
    ".svelte": "Svelte",
    ".astro": "Astro",
    ".graphql": "GraphQL",
    ".gql": "GraphQL",
    ".tf": "Terraform",
    ".dockerfile": "Docker",
    ".makefile": "Make",
    ".cmake": "CMake",
    ".bat": "Batch",
    ".ps1": "PowerShell",
    ".env": "Env",
    ".gitignore": "Git",
    ".editorconfig": "EditorConfig",
    ".prettierrc": "Prettier",
    ".eslintrc": "ESLint",
    ".ini": "INI",
    ".cfg": "Config",
}

# --- exact file name -> language (used only when the extension is unknown) -------------------
FILE_NAMES_BY_LANGUAGE = {
    "Python": ["requirements.txt", "setup.py", "setup.cfg", "pyproject.toml", "Pipfile", "tox.ini"],
    "JavaScript": ["package.json", "package-lock.json", "webpack.config.js", "rollup.config.js"],
    "TypeScript": ["tsconfig.json", "tslint.json"],
    "Java": ["pom.xml", "build.gradle", "gradlew"],
    "Go": ["go.mod", "go.sum"],
    "Rust": ["Cargo.toml", "Cargo.lock"],
    "Ruby": ["Gemfile", "Gemfile.lock", "Rakefile"],
    "PHP": ["composer.json", "composer.lock"],
    "Swift": ["Package.swift"],
    "Dart": ["pubspec.yaml", "pubspec.lock"],
}

# --- extension sets ----------------------------------------------------------------------------
PREVIEW_EXTENSIONS = [
    ".py", ".js", ".ts", ".jsx", ".tsx", ".java", ".go", ".rs", ".cs", ".php", ".rb", ".css",
    ".scss", ".html", ".yaml", ".yml", ".json", ".xml", ".md",
]
MODULE_EXTENSIONS = [".py", ".js", ".ts", ".jsx", ".tsx", ".java", ".go", ".rs", ".cs", ".php", ".rb"]
METRIC_EXTENSIONS = [
    ".py", ".js", ".jsx", ".ts", ".tsx", ".java", ".c", ".cpp", ".h", ".hpp", ".go", ".rs", ".cs",
    ".php", ".rb", ".kt", ".swift", ".dart", ".scala", ".lua", ".sh", ".r",
]
ARCH_CONTENT_SUFFIXES = [".py", ".js", ".ts", ".java", ".md", ".yaml", ".yml", ".json"]

# --- limits that are features ------------------------------------------------------------------
PREVIEW_CHARS = 3000
README_CHARS = 5000
ARCH_CONTENT_CHARS = 5000
SNIPPET_CHARS = 500
README_NAMES = ["README.md", "README.rst", "README.txt", "README"]
DIRECTORY_NODES = 60
DIRECTORY_LEVELS = 5
EVIDENCE_ITEMS = 10
RELEVANT_FILES = 4
HISTORY_TURNS = 10
SOURCE_ITEMS = 10
RECENT_COMMITS = 20

# --- frameworks: root files, dependency names, category -----------------------------------------
FRAMEWORKS = [
    ("react", [".babelrc", "tsconfig.json"], ["react", "react-dom", "next", "gatsby", "react-scripts"], "frontend"),
    ("vue", ["vue.config.js"], ["vue", "vue-router", "vuex", "nuxt"], "frontend"),
    ("angular", ["angular.json", "tsconfig.app.json"], ["@angular/core", "@angular/common"], "frontend"),
    ("django", ["manage.py", "urls.py", "wsgi.py"], ["django"], "backend"),
    ("flask", [], ["flask"], "backend"),
    ("fastapi", [], ["fastapi"], "backend"),
    ("express", [], ["express"], "backend"),
    ("spring", ["pom.xml", "build.gradle"], ["spring-boot", "spring-core", "spring-web"], "backend"),
    ("rails", ["Gemfile", "Rakefile", "config/routes.rb"], ["rails", "activerecord"], "backend"),
    ("tensorflow", [], ["tensorflow", "tf-nightly"], "ai"),
    ("pytorch", [], ["torch", "pytorch"], "ai"),
    ("jest", [], ["jest", "ts-jest"], "testing"),
    ("junit", [], ["junit", "jupiter"], "testing"),
    ("pytest", [], ["pytest"], "testing"),
    ("docker", ["Dockerfile", "docker-compose.yml", "docker-compose.yaml"], [], "devops"),
    ("kubernetes", ["deployment.yaml", "service.yaml", "kustomization.yaml"], [], "devops"),
]

# --- manifest file name -> ecosystem -------------------------------------------------------------
MANIFEST_SOURCES = {
    "package.json": "npm",
    "requirements.txt": "pypi",
    "Cargo.toml": "cargo",
    "go.mod": "go",
    "Gemfile": "rubygems",
    "pubspec.yaml": "pub",
    "pom.xml": "maven",
}
NPM_GROUPS = [("dependencies", "dependencies"), ("devDependencies", "dev"), ("peerDependencies", "peer")]
VERSION_PREFIX_CHARS = "^~>=<"

# --- architecture patterns (case-insensitive indicators), description, layers --------------------
ARCHITECTURES = [
    ("MVC", ["controllers?", "views?", "models?", "routes?"]),
    ("Layered Architecture",
     ["layers?", "presentation", "business(?:ness)?", "persistence", "repositor(?:y|ies)"]),
    ("Microservices",
     ["microservice", r"service\s*-\s*\w+", r"api\s*gateway", "docker-compose", "kubernetes"]),
    ("Clean Architecture",
     [r"use\s*cases?", "entities?", r"interfaces?\s*adapters?", "infrastructure"]),
    ("Event-Driven Architecture",
     [r"event\s*(?:bus|sourcing|driven)", r"message\s*(?:queue|broker|bus)", "publish", "subscribe",
      "rabbitmq|kafka|redis"]),
    ("Hexagonal Architecture",
     [r"ports?\s*and\s*adapters?", "hexagonal", "inbound", "outbound", r"driven\s*ports?"]),
    ("Serverless Architecture", ["serverless", r"lambda\s*function", r"cloud\s*function", "faas"]),
    ("Domain-Driven Design",
     [r"domain\s*(?:model|service|event)", "aggregate", r"bounded\s*context", r"value\s*object"]),
    ("Client-Server",
     [r"\bclient\b", r"\bserver\b", r"\bfrontend\b|front-end", r"\bbackend\b|back-end"]),
]
#: Texts one of which stands in every match of the indicator in the same place above; looked for before its pattern.
ARCHITECTURE_LITERALS = [
    [["controller"], ["view"], ["model"], ["route"]],
    [["layer"], ["presentation"], ["business"], ["persistence"], ["repository", "repositories"]],
    [["microservice"], ["service"], ["gateway"], ["docker-compose"], ["kubernetes"]],
    [["case"], ["entit"], ["adapter"], ["infrastructure"]],
    [["event"], ["message"], ["publish"], ["subscribe"], ["rabbitmq", "kafka", "redis"]],
    [["adapter"], ["hexagonal"], ["inbound"], ["outbound"], ["driven"]],
    [["serverless"], ["lambda"], ["cloud"], ["faas"]],
    [["domain"], ["aggregate"], ["bounded"], ["value"]],
    [["client"], ["server"], ["frontend", "front-end"], ["backend", "back-end"]],
]
ARCHITECTURE_PROFILES = {
    "MVC": ("Model-View-Controller architecture with separation of data, UI, and logic",
            ["Model (Data Layer)", "View (Presentation Layer)", "Controller (Business Logic)"]),
    "Layered Architecture": ("Organized into horizontal layers with strict dependency direction",
                             ["Presentation", "Business Logic", "Persistence", "Database"]),
    "Microservices": ("Distributed architecture with independently deployable services",
                      ["API Gateway", "Individual Services", "Message Bus", "Data Stores"]),
    "Clean Architecture": ("Dependency inversion with concentric layers of abstraction",
                           ["Frameworks & Drivers", "Interface Adapters", "Application Logic", "Domain Entities"]),
    "Event-Driven Architecture": ("Asynchronous communication through event production and consumption",
                                  ["Event Producers", "Event Bus", "Event Consumers", "Event Store"]),
    "Hexagonal Architecture": ("Ports and adapters pattern with core business logic isolation",
                               ["Inbound Adapters", "Ports", "Core Domain", "Outbound Adapters"]),
    "Serverless Architecture": ("Cloud-native architecture with function-as-a-service components",
                                ["API Gateway", "Functions", "Event Sources", "Managed Services"]),
    "Domain-Driven Design": ("Business domain centric design with bounded contexts",
                             ["Presentation", "Application", "Domain", "Infrastructure"]),
    "Client-Server": ("Traditional two-tier architecture with distinct client and server components",
                      ["Client Application", "Network", "Server Application", "Database"]),
}
# Score weights in tenths (directory 1, file name 0.5, content 0.3), so sums stay integral.
ARCH_TENTHS = {"directory": 10, "file": 5, "content": 3}
MAX_CONFIDENCE = 99.0

# --- symbol patterns -----------------------------------------------------------------------------
JS_IMPORTS = [
    r"""import\s+(?:\{[^}]*\}\s+from\s+)?["']([^"']+)["']""",
    r"""import\s+\w+\s+from\s+["']([^"']+)["']""",
    r"""require\(["']([^"']+)["']\)""",
    r"""import\s+["']([^"']+)["']""",
]
JS_EXPORTS = [  # (pattern, group)
    (r"export\s+(?:default\s+)?(?:function|class|const|let|var)\s+(\w+)", 1),
    (r"export\s+\{[^}]+\}", 0),
    (r"module\.exports\s*=\s*(\w+)", 1),
]
#: A text that stands in every match of the pattern in the same place above.
JS_IMPORT_LITERALS = ["import", "from", "require(", "import"]
JS_EXPORT_LITERALS = ["export", "export", "module.exports"]
JS_CLASS = r"class\s+(\w+)(?:\s+extends\s+(\w+))?"
JS_FUNCTION = (r"(?:async\s+)?function\s+(\w+)|(\w+)\s*=\s*(?:async\s+)?\([^)]*\)\s*=>"
               r"|(\w+)\s*\([^)]*\)\s*\{")
#: The same matches, each run of word characters or blanks entered once: time linear in the text.
JS_FUNCTION_LINEAR = (r"(?:async\s++)?function\s++(\w++)|(?<!\w)(\w++)\s*+=\s*+(?:async\s++)?\([^)]*+\)\s*+=>"
                      r"|(?<!\w)(\w++)\s*+\([^)]*+\)\s*+\{")
JS_NOT_FUNCTIONS = ["if", "while", "for", "switch", "catch"]
JAVA_IMPORT = r"import\s+([\w.]+);"
JAVA_CLASS = (r"(?:public|private|protected)?\s*(?:abstract|final)?\s*class\s+(\w+)"
              r"(?:\s+extends\s+(\w+))?(?:\s+implements\s+([\w,\s]+))?")
#: The same matches; blanks before a class belong to the match only from the first of them on.
JAVA_CLASS_LINEAR = (r"(?:(?:public|private|protected)\s*+(?:(?:abstract|final)\s*+)?"
                     r"|(?:(?<!\s)\s++)?(?:(?:abstract|final)\s*+)?)class\s++(\w++)"
                     r"(?:\s++extends\s++(\w++))?+(?:\s++implements\s++([\w,\s]+))?")
GO_IMPORT_BLOCK = r"import\s+\((.*?)\)"
GO_IMPORT_ITEM = r'"([^"]+)"'
GO_IMPORT = r'import\s+"([^"]+)"'
GO_FUNCTION = r"func\s+(\w+)"
GO_STRUCT = r"type\s+(\w+)\s+struct"
RUST_IMPORT = r"(?:use|extern crate)\s+([\w:]+)"
RUST_FUNCTION = r"fn\s+(\w+)"
RUST_TYPE = r"(?:struct|impl)\s+(\w+)"
CSHARP_IMPORT = r"using\s+([\w.]+);"
PHP_IMPORT = r"(?:use|require|include)\s+([\w\\/]+)"
PHP_FUNCTION = r"function\s+(\w+)"
ANY_CLASS = r"class\s+(\w+)"

# --- call graph: definition patterns per extension, looked for line by line -----------------------
CALL_DEFINITIONS = {
    ".js": r"(?:async\s+)?function\s+(\w+)|const\s+(\w+)\s*=",
    ".ts": r"(?:async\s+)?function\s+(\w+)|const\s+(\w+)\s*=",
    ".go": r"func\s+(?:\([^)]+\)\s+)?(\w+)",
    ".rs": r"fn\s+(\w+)",
    ".java": r"(?:public|private|protected)\s+\w+\s+(\w+)\s*\(",
    ".php": r"function\s+(\w+)",
    ".rb": r"def\s+(\w+)",
}
CALL = r"(\w+)\s*\("
#: The same matches, each run of word characters entered once.
CALL_LINEAR = r"(?<!\w)(\w++)\s*+\("
NOT_CALLS = ["if", "while", "for", "switch", "catch", "return", "throw", "typeof", "instanceof",
             "new", "delete", "function"]

# --- generic metrics -------------------------------------------------------------------------------
GENERIC_FUNCTION = r"(?:def|function|func|fn)\s+\w+"
#: The same matches; most places are left by their first letter.
GENERIC_FUNCTION_LINEAR = r"[df](?:(?<=d)ef|(?<=f)(?:unction|unc|n))\s+\w+"
GENERIC_CLASS = r"(?:class|struct)\s+\w+"
#: Texts one of which stands in every match.
GENERIC_FUNCTION_LITERALS = ["def", "func", "fn"]
GENERIC_CLASS_LITERALS = ["class", "struct"]

# --- database schemas ------------------------------------------------------------------------------
SQL_CREATE_TABLE = r"CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?`?(\w+)`?\s*\((.*?)\);"
SQL_COLUMN = r"^\s*`?(\w+)`?\s+(\w+(?:\s*\([^)]+\))?)"
SQL_PRIMARY_KEY = r"PRIMARY\s+KEY\s*\(`?(\w+)`?\)"
SQL_FOREIGN_KEY = r"FOREIGN\s+KEY\s*\(`?(\w+)`?\)\s*REFERENCES\s+`?(\w+)`?\s*\(`?(\w+)`?\)"
SQL_NOT_COLUMNS = ["PRIMARY", "FOREIGN", "INDEX", "UNIQUE", "CONSTRAINT", "KEY"]
LARAVEL_TABLE = (r"""Schema::create\(\s*['"](\w+)['"]\s*,\s*function\s*\((?:Blueprint\s*)?\$table\)"""
                 r"\s*\{(.*?)\}\)")
LARAVEL_COLUMN = r"""\$table->(\w+)\s*\(\s*['"](\w+)['"]"""
LARAVEL_DEFAULTS = [
    ("id", ["id"]),
    ("bigIncrements", ["id"]),
    ("increments", ["id"]),
    ("timestamps", ["created_at", "updated_at"]),
    ("nullableTimestamps", ["created_at", "updated_at"]),
    ("softDeletes", ["deleted_at"]),
    ("rememberToken", ["remember_token"]),
]
LARAVEL_KEYS = ["id", "bigIncrements", "increments"]
ALEMBIC_TABLE = r"""op\.create_table\(\s*['"](\w+)['"]\s*,\s*(.*?)(?=\)\s*\))"""
ALEMBIC_COLUMN = r"""sa\.Column\(\s*['"](\w+)['"]\s*,\s*sa\.(\w+)"""
DJANGO_MODEL = r"class\s+(\w+)\s*\(.*?models\.\w+.*?\)\s*:\s*\n(.*?)(?=\nclass|\z)"
DJANGO_FIELD = r"(\w+)\s*=\s*models\.(\w+)\("
DJANGO_FIELD_LINEAR = r"(?<!\w)(\w++)\s*+=\s*+models\.(\w++)\("
SQLALCHEMY_MODEL = r"class\s+(\w+)\s*\(.*?Base.*?\)\s*:\s*\n(.*?)(?=\nclass|\z)"
SQLALCHEMY_COLUMN = r"(\w+)\s*=\s*Column\("
SQLALCHEMY_COLUMN_LINEAR = r"(?<!\w)(\w++)\s*+=\s*+Column\("
TYPEORM_ENTITY = r"@Entity.*?\n\s*class\s+(\w+).*?\{([^}]*)\}"
TYPEORM_PROPERTY = r"(\w+)\s*[:=]\s*(\w+)"
TYPEORM_PROPERTY_LINEAR = r"(?<!\w)(\w++)\s*+[:=]\s*+(\w++)"
TYPEORM_NOT_PROPERTIES = ["export", "default", "class", "extends", "implements"]
PRISMA_MODEL = r"model\s+(\w+)\s*\{([^}]*)\}"
PRISMA_FIELD = r"^\s+(\w+)\s+(\w+(?:\s*\[\])?)\s*(@relation\([^)]*\))?\s*$"
PRISMA_NOT_TYPES = ["model", "enum"]

# --- health score ------------------------------------------------------------------------------------
HEALTH_WEIGHTS = {
    "security": 20,
    "maintainability": 15,
    "documentation": 10,
    "testing": 15,
    "architecture": 10,
    "performance": 5,
    "quality": 10,
    "complexity": 5,
    "dependency": 5,
    "activity": 5,
}
SECURITY_WORDS = [".env", "security", "auth", "jwt", "oauth", "cors", "helmet", "csrf", "xss", "sanitize",
                  "validator"]
DOC_WORDS = ["doc", "readme", "wiki", "guide"]
TEST_WORDS = ["test", "spec", "mock"]
PERFORMANCE_WORDS = ["cache", "redis", "memcached", "index", "optimize", "lazy", "throttle", "debounce",
                     "batch"]
OUTDATED_WORDS = ["legacy", "deprecated", "v0", "alpha", "beta", "dev"]
RECOMMENDATIONS = [  # (metric, threshold, message): shown when the score is below the threshold
    ("security", 70, "Improve security by adding authentication, input validation, and security headers"),
    ("documentation", 60, "Add comprehensive documentation including README, API docs, and code comments"),
    ("testing", 60, "Increase test coverage by adding unit and integration tests"),
    ("maintainability", 60, "Refactor large functions and improve code organization"),
    ("quality", 60, "Address code quality issues and follow consistent coding standards"),
    ("complexity", 60, "Reduce complexity by breaking down complex functions and modules"),
    ("dependency", 70, "Update outdated dependencies and remove unused packages"),
]
HEALTH_LABELS = [(80, "Excellent"), (60, "Good"), (40, "Fair")]
HEALTH_LABEL_REST = "Needs Work"

# --- question words ------------------------------------------------------------------------------------
STOP_WORDS = [
    "the", "a", "an", "is", "are", "was", "were", "be", "been",
    "do", "does", "did", "has", "have", "had", "can", "could",
    "will", "would", "shall", "should", "may", "might", "must",
    "this", "that", "these", "those", "it", "its", "they", "them",
    "what", "where", "when", "why", "how", "which", "who", "whom",
    "in", "on", "at", "to", "for", "of", "with", "by", "from",
    "and", "or", "but", "not", "if", "then", "else", "so",
    "explain", "describe", "tell", "show", "find", "locate",
    "work", "about", "please",
]

# --- prompt text ------------------------------------------------------------------------------------------
PROMPT_CLOSING = (
    "\n\nAnswer the user's question about this repository using the context and your knowledge."
    " Reference specific files and code. Be concise."
)
DIAGRAM_FALLBACK_SEQUENCE = ["Client", "Server", "Database"]
DIAGRAM_FALLBACK_LAYERS = ["Presentation", "Application", "Domain", "Infrastructure"]

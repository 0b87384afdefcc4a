"""Word lists, lookup tables, limits and patterns that decide results.

Everything in this file is data. Column functions and operators import it; nothing here runs Spark.
"""

# Directory names and lockfiles that are never part of a corpus.
IGNORED_DIRS = (
    "node_modules", ".git", "dist", "build", "out", ".next", ".nuxt", "vendor", "target",
    "__pycache__", ".venv", "venv", "env", ".tox", "coverage", ".idea", ".vscode", "bin", "obj",
    ".gradle", ".cache", ".turbo", ".svelte-kit", "site-packages", ".pytest_cache", ".mypy_cache",
)
IGNORED_FILES = (
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "go.sum", "poetry.lock", "Cargo.lock",
    "composer.lock", "Gemfile.lock", "uv.lock",
)
IGNORED_NAME_PATTERN = r"\.min\.(js|css)$|\.map$|\.d\.ts$"

# Language by file extension, and by whole file name.
LANGUAGE_BY_EXT = {
    ".ts": "TypeScript", ".tsx": "TypeScript", ".mts": "TypeScript", ".cts": "TypeScript",
    ".js": "JavaScript", ".jsx": "JavaScript", ".mjs": "JavaScript", ".cjs": "JavaScript",
    ".py": "Python", ".java": "Java", ".go": "Go", ".kt": "Kotlin", ".rb": "Ruby", ".php": "PHP",
    ".rs": "Rust", ".cs": "C#", ".c": "C", ".h": "C", ".cpp": "C++", ".hpp": "C++", ".swift": "Swift",
    ".scala": "Scala", ".vue": "Vue", ".svelte": "Svelte", ".sql": "SQL", ".prisma": "Prisma",
    ".graphql": "GraphQL", ".gql": "GraphQL", ".sh": "Shell", ".html": "HTML", ".css": "CSS",
    ".scss": "CSS", ".md": "Markdown", ".json": "JSON", ".yml": "YAML", ".yaml": "YAML",
    ".toml": "TOML", ".xml": "XML", ".gradle": "Gradle", ".proto": "Protobuf",
}
LANGUAGE_BY_NAME = {
    "Dockerfile": "Docker", "Makefile": "Make", "requirements.txt": "Text", ".env.example": "Text",
    "Procfile": "Text",
}
NON_SOURCE_LANGUAGES = (
    "Markdown", "JSON", "YAML", "TOML", "XML", "Text", "Docker", "Make", "Gradle", "HTML", "CSS",
)

# Path words for logical modules.
SOURCE_ROOTS = (
    "src", "lib", "app", "source", "main", "java", "kotlin", "python", "pkg", "internal", "cmd",
    "server", "backend",
)
MONO_ROOTS = ("packages", "apps", "services", "modules", "libs")
PACKAGE_ROOTS = ("com", "org", "net", "io", "dev")
CONTAINER_DIRS = (
    "routes", "modules", "features", "domains", "domain", "api", "handlers", "controllers",
    "services", "components", "pages", "views",
)

# Limits. Guards of one machine's memory are off by default in the operators.
MAX_FILE_BYTES = 512 * 1024
MAX_FILES_PER_REPOSITORY = 6000
CHUNK_LINES = 60
MAX_TEXT_CHUNKS = 20
MAX_HEADING_CHUNKS = 40
MAX_KEYWORDS = 16
MAX_CALLS = 60
MAX_MODULE_CALLS = 40
CLIP_LINES = {"entity": 400, "class": 150, "type": 80, "route": 120}
EMBEDDING_DIMENSIONS = 384
EMBEDDING_CONTENT_CHARS = 1200
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "
FRONTIER_CAP = 60
IMPACT_DEPTH = 3
CONTEXT_BUDGET = 24000

# Entity types.
DOC_TYPES = ("doc", "config")
NON_OUTLINE_TYPES = ("doc", "config", "chunk")
LINKABLE_TYPES = ("function", "method", "component", "class", "model")
TARGET_TYPES = ("function", "method", "class", "component", "model", "interface")
MEMBER_OWNER_TYPES = ("class", "model", "interface")

# Question classes, tried in this order on lower-case text.
QUESTION_PATTERNS = (
    ("impact", r"\b(affect(ed|s)?|impact(ed)?|break(s)?|rename|renaming|if i (change|modify|delete|remove|refactor))\b"),
    ("dependency", r"\b(depends? on|dependenc(y|ies)|used by|who calls|callers?|what calls|usages?|uses of)\b"),
    ("routes", r"\b(all|list|show|what)\b.*\b(routes?|endpoints?|apis?)\b"),
    ("architecture", r"\b(architecture|structure|overview|organi[sz]ed|high[- ]level|important modules|main modules|understand first|new developer|onboard|tech stack)\b"),
    ("debugging", r"\b(error|bug|fail(s|ing|ure)?|exception|crash|40\d|50\d|why (does|is|could|would|am|do))\b"),
    ("implementation", r"\b(how (should|can|would|do) i|add(ing)? (a|an|new|support)|implement|extend|integrate)\b"),
    ("flow", r"\b(flow|how does|how do|what happens|lifecycle|walk me through|works?)\b"),
    ("location", r"\b(where|which files?|find|locate|defined|handled|created|initiali[sz]ed)\b"),
)

# Words that are never search terms.
STOP_WORDS = tuple(dict.fromkeys((
    "a an the is are was were be been being of to in on for and or with by from at as it this that these those "
    "what which who whom where when why how do does did can could should would will i we you me my our your there "
    "their them they its into about show tell explain give list all any some file files code codebase repo "
    "repository function functions method methods class classes handled happens happen work works used using get "
    "gets make need want if change changed changing affected affect would"
).split()))

# Identifier shapes in a question.
WORD_PATTERN = r"[A-Za-z_][A-Za-z0-9_]*"
BACKTICK_PATTERN = r"`([^`]+)`"
CALL_MENTION_PATTERN = r"\b([A-Za-z_]\w*)\(\)"
IDENTIFIER_PATTERN = r"\b([a-z]+[A-Z]\w*|[A-Z][a-z0-9]+[A-Z]\w*|[a-z]+_[a-z_0-9]+)\b"

# Path and question predicates.
TEST_FILE_PATTERN = r"(^|/)(tests?|__tests__|e2e|spec)/|\.(test|spec)\.\w+$|(^|/)test_[^/]*$|_test\.\w+$"
GENERATED_FILE_PATTERN = r"\.gen\.\w+$|(^|/)generated/|\.pb\.\w+$"
ABOUT_TESTS_PATTERN = r"(?i)\b(tests?|spec|testing|coverage)\b"
ENTRY_POINT_PATTERN = (
    r"(^|/)(main\.(go|py|ts|js|java)|index\.(ts|js)|server\.(ts|js|py)|app\.(ts|js|py)|manage\.py|wsgi\.py|"
    r"asgi\.py|__main__\.py|Application\.java|[A-Z]\w*Application\.java)$"
)
MANIFEST_PATTERN = r"(^|/)(package\.json|requirements\.txt|pyproject\.toml|pom\.xml|build\.gradle(\.kts)?|go\.mod)$"

# Framework tags by manifest text.
FRAMEWORK_PATTERNS = (
    (r'"next"\s*:', "Next.js"), (r'"react"\s*:', "React"), (r'"vue"\s*:', "Vue"), (r'"@angular/core"', "Angular"),
    (r'"svelte"\s*:', "Svelte"), (r'"express"\s*:', "Express"), (r'"@nestjs/core"', "NestJS"),
    (r'"fastify"\s*:', "Fastify"), (r'"koa"\s*:', "Koa"), (r'"hono"\s*:', "Hono"),
    (r'"prisma"|"@prisma/client"', "Prisma"), (r'"mongoose"\s*:', "Mongoose"), (r'"sequelize"\s*:', "Sequelize"),
    (r'"typeorm"\s*:', "TypeORM"), (r'"drizzle-orm"', "Drizzle"), (r'"jsonwebtoken"|"passport"', "JWT/Passport auth"),
    (r"(?i)\bdjango\b", "Django"), (r"(?i)\bflask\b", "Flask"), (r"(?i)\bfastapi\b", "FastAPI"),
    (r"(?i)\bsqlalchemy\b", "SQLAlchemy"), (r"spring-boot", "Spring Boot"), (r"gin-gonic/gin", "Gin"),
    (r"labstack/echo", "Echo"), (r"go-chi/chi", "Chi"), (r"gofiber/fiber", "Fiber"), (r"gorm\.io/gorm", "GORM"),
)

# Repository addresses.
GITHUB_URL_PATTERN = (
    r"^(?:https?://(?:www\.)?github\.com/|git@github\.com:)([\w.-]+)/([\w.-]+?)(?:\.git)?"
    r"(?:/tree/([^?#]+))?/?(?:[?#].*)?$"
)
GIT_REMOTE_PATTERN = (
    r"(?i)^(?:git@github\.com:|ssh://git@github\.com/|https?://(?:[^@/]+@)?(?:www\.)?github\.com/|"
    r"git://github\.com/)([\w.-]+)/([\w.-]+?)(?:\.git)?/?$"
)
LOCAL_PATH_PATTERN = r"^([a-zA-Z]:[\\/]|/)"

# Import resolution.
JS_CANDIDATE_SUFFIXES = (
    "", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx",
)
MAX_GO_TARGETS = 15
MAX_CALL_TARGETS = 3
MAX_GLOBAL_CANDIDATES = 2

# Search and fusion.
SEARCH_DEPTH = 40
SYMBOL_DEPTH = 30
FUSED_DEPTH = 30
RRF_K = 60
KEYWORD_WEIGHT = 0.8
IDENTIFIER_BONUS = 3.0
WORD_BONUS = 1.2
NAME_WEIGHT, PATH_WEIGHT, CONTENT_WEIGHT = 1.0, 0.4, 0.1
TEXT_LANGUAGE = "english"

# The wording of evidence, which counts toward its budget, and the lengths of its lists.
EVIDENCE_LABELS = {
    "target": "target of the question", "callee": " depends on this", "impact": "impact ", "route": "API route",
    "focus": "entity selected by the user", "retrieved": "matched by ", "related_out": "called by ", "related_in": "calls ",
    "impact_of": "Change impact analysis for ", "computed": "), computed by traversing the call graph:\n",
    "no_callers": "- No callers found in the indexed call graph.", "importing": "\nFiles importing ",
    "depends": "\nDepends on: ", "no_callees": "nothing resolved",
    "overview": "Repository overview (computed during indexing):\n", "languages": "Languages: ", "frameworks": "\nFrameworks: ",
    "entry_points": "\nEntry points: ", "largest": "\nLargest modules: ", "connected": "\nMost connected modules: ",
}
EVIDENCE_LENGTHS = {
    "callees": 5, "impacts": 14, "listed_impacts": 30, "listed_importers": 15, "listed_callees": 15, "routes": 40,
}

# Answer checks.
ANSWER_PATH_PATTERN = (
    r"[\w@~-]+(?:/[\w@.~-]+)*\.(?:tsx?|jsx?|mjs|cjs|py|java|go|json|md|ya?ml|toml|sql|prisma|rb|php|rs|cs|kt|vue|"
    r"svelte|gradle|xml|html|css)\b"
)
MAX_ANSWER_PATHS = 40
CITATION_PATTERN = r"\[S(\d+)\]"
CODE_REFERENCE_PATTERN = r"^([\w@~./-]+\.\w+)(?::(\d+)(?:\s*[-–]\s*(\d+))?)?$"

# Starter questions, each with the symbol-name pattern that calls for it.
OVERVIEW_QUESTIONS = (
    "Explain the architecture of this codebase.", "What should I understand first as a new developer?",
)
STARTER_PATTERNS = {
    "auth": "auth|login|jwt|token|session",
    "signup": "regist|signup|sign_up|createuser",
    "database": "connect|database|db|prisma|sequelize|engine|datasource",
    "payment": "pay|stripe|checkout|order",
}
STARTER_QUESTIONS = {
    "auth": ("Where is authentication handled?", "How does login work?"),
    "signup": ("How does a user registration request flow through the system?",),
    "database": ("Where are database connections created?",),
    "routes": ("Show me all API routes.",),
    "payment": ("What handles payment or order processing?",),
}
MAX_SUGGESTIONS = 8

# HTTP verbs of call-style and file-path routes.
HTTP_VERBS = ("get", "post", "put", "patch", "delete", "all", "options", "head")

# White space as JavaScript's \s and trim() see it (for Java regular expressions).
JS_SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
JS_NON_SPACE = r"[^\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"

# Calls, base classes and annotations that make a model or a component.
MODEL_CALL = r"\b(model|Schema|define|pgTable|mysqlTable|sqliteTable)$"
COMPONENT_CALL = r"(memo|forwardRef|styled|observer)"
PYTHON_MODEL_BASES = r"(models\.Model|\bBase\b|BaseModel|db\.Model|SQLModel|Document|DeclarativeBase)"
JAVA_MODEL = r"@(Entity|Table|Document)\b"

# Files of file-path routers, and lines that are no code of a module.
APP_ROUTE_FILE = r"(?:^|/)app/(.*?)/?route\.(?:t|j)sx?$"
PAGES_ROUTE_FILE = r"(?:^|/)pages/(api/.*?)(?:/index)?\.(?:t|j)sx?$"
IMPORT_OR_COMMENT = r"^(import |from \S+ import|package |#include|//|\*|/\*)"

# The English stemming rules (Porter2) and the stop words that go with them in text search.
STEM_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
STEM_BEFORE_LI = ("c", "d", "e", "g", "h", "k", "m", "n", "r", "t")
STEM_PREFIXES = ("gener", "commun", "arsen")
STEM_EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
STEM_SETTLED = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
STEM_STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize",
    "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous",
    "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
STEM_STEP_3 = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "",
}
STEM_STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize",
)
ENGLISH_STOP_WORDS = frozenset((
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its "
    "itself they them their theirs themselves what which who whom this that these those am is are was were be been being "
    "have has had having do does did doing a an the and but if or because as until while of at by for with about against "
    "between into through during before after above below to from up down in out on off over under again further then once "
    "here there when where why how all any both each few more most other some such no nor not only own same so than too "
    "very s t can will just don should now"
).split())

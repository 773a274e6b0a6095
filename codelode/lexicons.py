"""Word lists, lookup tables and patterns.

Fixed values: results depend on these exact entries and on their order. Patterns use plain regular-expression
syntax; rule position and pattern position are the positions in these tables.
"""

# --- directories that scans leave out --------------------------------------------------------------------------------
# Path components, compared literally ("*.egg-info" is a name, not a glob).
ANALYSIS_SKIP = [
    ".git", "node_modules", "venv", ".venv", "__pycache__", "dist", "build", ".next", "target", "coverage", ".tox",
    "eggs", "*.egg-info", ".mypy_cache", ".pytest_cache",
]
LANGUAGE_SKIP = [
    "node_modules", "venv", ".venv", "vendor", "__pycache__", ".git", "dist", "build", ".next", "target", "coverage",
]
CORPUS_SKIP = [
    ".git", "node_modules", "venv", ".venv", "__pycache__", "dist", "build", ".next", "target", "coverage",
]
SEARCH_SKIP = [".git", "node_modules", "venv", ".venv", "__pycache__", "dist", "build"]
DISCOVERY_SKIP = ["node_modules", "venv", ".venv", "vendor", "__pycache__", ".git"]

# --- file suffixes -----------------------------------------------------------------------------------------------------
# Suffixes with their leading dot.
SOURCE_SUFFIXES = [
    ".py", ".js", ".ts", ".tsx", ".jsx", ".go", ".rs", ".java", ".kt", ".swift", ".c", ".cpp", ".h", ".hpp", ".rb",
    ".php", ".cs", ".scala", ".ex", ".exs",
]
CORPUS_SUFFIXES = [".py", ".js", ".ts", ".tsx", ".jsx", ".go", ".rs", ".java", ".rb"]
FRAMEWORK_SUFFIXES = [".py", ".js", ".ts", ".tsx"]
ENDPOINT_SUFFIXES = [".py", ".js", ".ts"]
CODE_SUFFIXES = [
    ".py", ".js", ".ts", ".tsx", ".jsx", ".go", ".rs", ".java", ".kt", ".swift", ".c", ".cpp", ".h", ".hpp", ".rb",
    ".php", ".cs", ".scala",
]
BINARY_SUFFIXES = [".png", ".jpg", ".jpeg", ".gif", ".ico", ".pdf", ".zip", ".tar", ".gz"]

# Suffix to language, per-file metrics.
LANGUAGES = {
    ".py": "Python", ".js": "JavaScript", ".ts": "TypeScript", ".tsx": "TypeScript", ".jsx": "JavaScript",
    ".go": "Go", ".rs": "Rust", ".java": "Java", ".kt": "Kotlin", ".swift": "Swift", ".c": "C", ".cpp": "C++",
    ".h": "C", ".hpp": "C++", ".rb": "Ruby", ".php": "PHP", ".cs": "C#",
}
# Suffix to language, file shares.
WIDE_LANGUAGES = {
    ".py": "Python", ".js": "JavaScript", ".ts": "TypeScript", ".tsx": "TypeScript", ".jsx": "JavaScript",
    ".go": "Go", ".rs": "Rust", ".java": "Java", ".kt": "Kotlin", ".swift": "Swift", ".c": "C", ".cpp": "C++",
    ".h": "C", ".hpp": "C++", ".rb": "Ruby", ".php": "PHP", ".cs": "C#", ".scala": "Scala", ".clj": "Clojure",
    ".ex": "Elixir", ".exs": "Elixir", ".erl": "Erlang", ".hs": "Haskell", ".lua": "Lua", ".r": "R", ".jl": "Julia",
    ".dart": "Dart", ".vue": "Vue", ".svelte": "Svelte", ".sql": "SQL", ".sh": "Shell", ".bash": "Shell",
    ".zsh": "Shell",
}

# --- line and test-file rules --------------------------------------------------------------------------------------------
# What a comment line begins with; other languages have none.
COMMENT_PREFIXES = {
    ("Python",): ["#", '"""', "'''"],
    ("JavaScript", "TypeScript", "Java", "Go", "Rust", "C", "C++"): ["//", "/*", "*"],
    ("Ruby",): ["#"],
}
TEST_PATH_PARTS = ["test_", "_test.", ".test.", "spec.", "_spec.", "/tests/", "/test/", "/__tests__/"]
TEST_CONTENT_PATTERNS = [
    r"def test_\w+", r"@pytest", r"unittest\.TestCase", r"describe\(['\"]", r"it\(['\"]", r"expect\(", r"assert\s+",
]

# --- per-language structure patterns ---------------------------------------------------------------------------------------
# Counts add up over the patterns of a list.
JS_FUNCTION_PATTERNS = [
    r"function\s+\w+\s*\(", r"const\s+\w+\s*=\s*(?:async\s*)?\(", r"(?:async\s+)?function\s*\(",
    r"\w+\s*:\s*(?:async\s*)?\(", r"=>\s*\{",
]
JS_CLASS_PATTERN = r"class\s+\w+"
JS_IMPORT_PATTERNS = [r"import\s+.*?\s+from\s+['\"]([^'\"]+)['\"]", r"require\(['\"]([^'\"]+)['\"]\)"]
JS_BRANCH_PATTERNS = [r"\bif\s*\(", r"\bfor\s*\(", r"\bwhile\s*\(", r"\bswitch\s*\("]
GO_FUNCTION_PATTERN = r"func\s+(?:\([^)]+\)\s*)?\w+\s*\("
GO_STRUCT_PATTERN = r"type\s+\w+\s+struct"
GO_IMPORT_BLOCK_PATTERN = r"(?s)import\s*\((.*?)\)"
GO_IMPORT_PATTERN = r"import\s+\"([^\"]+)\""
GO_BRANCH_PATTERNS = [r"\bif\s+", r"\bfor\s+", r"\bswitch\s+"]

# --- repository-level lookups ------------------------------------------------------------------------------------------------
# File and directory names, in priority order.
README_NAMES = ["README.md", "README.rst", "README.txt", "README"]
CHANGELOG_NAMES = ["CHANGELOG.md", "CHANGELOG", "HISTORY.md", "CHANGES.md"]
CONTRIBUTING_NAME = "CONTRIBUTING.md"
# Words that show a section of a read-me, each list one section.
README_SECTIONS = [
    ["install", "setup", "getting started"], ["usage", "example", "how to"], ["api", "reference", "documentation"],
    ["license", "licence"], ["[!["],
]
# Files and folders that show tests, patterns of test names, and paths that show continuous integration.
TEST_INDICATORS = [
    "tests", "test", "__tests__", "spec", "specs", "pytest.ini", "jest.config.js", "jest.config.ts", ".pytest_cache",
    "conftest.py",
]
TEST_NAME_PATTERNS = [r"test_[^/]*\.py", r"[^/]*_test\.py", r"[^/]*\.test\.ts", r"[^/]*\.spec\.ts"]
CI_PATHS = [
    ".github/workflows", ".gitlab-ci.yml", ".circleci", "Jenkinsfile", ".travis.yml", "azure-pipelines.yml",
    ".drone.yml", "bitbucket-pipelines.yml",
]
# Names of configuration repositories, and file names in priority order.
CONFIG_REPO_NAMES = ["dotfiles", ".dotfiles", "config", ".config"]
CONFIG_FILES = [
    "package.json", "requirements.txt", "pyproject.toml", "Cargo.toml", "go.mod", "Gemfile", "docker-compose.yml",
    "Dockerfile", ".env.example", "README.md",
]
PACKAGE_FILES = ["package.json", "requirements.txt", "pyproject.toml", "Cargo.toml", "go.mod"]
KEY_FILES = [
    "main.py", "app.py", "index.py", "server.py", "cli.py", "main.js", "index.js", "app.js", "server.js", "main.ts",
    "index.ts", "app.ts", "server.ts", "main.go", "main.rs", "Dockerfile", "docker-compose.yml",
    "docker-compose.yaml", "Makefile", "justfile", ".env.example", ".env.sample", "setup.py", "pyproject.toml",
    "package.json", "Cargo.toml", "go.mod",
]
ENTRY_POINTS = [
    "main.py", "__main__.py", "app.py", "cli.py", "server.py", "run.py", "index.js", "main.js", "app.js", "server.js",
    "index.ts", "main.ts", "app.ts", "server.ts", "main.go", "cmd/main.go", "main.rs", "src/main.rs",
]
SNIPPET_FILES = [
    "main.py", "app.py", "cli.py", "server.py", "models.py", "schema.py", "routes.py", "handlers.py", "index.ts",
    "App.tsx", "main.ts",
]
TEST_FRAMEWORKS = ["pytest", "unittest", "Jest", "Mocha", "Vitest"]

# Library names looked for inside lowercase import names.
NOTABLE_LIBRARIES = [
    "requests", "aiohttp", "celery", "redis", "pydantic", "sqlalchemy", "alembic", "boto3", "opencv", "pillow",
    "matplotlib", "seaborn", "axios", "lodash", "moment", "dayjs", "rxjs", "socket.io", "graphql", "apollo", "redux",
    "zustand", "tanstack", "tailwindcss",
]

# Path fragments that point to a project type.
PROJECT_TYPES = {
    "web-app": ["src/pages", "src/views", "src/components", "templates/", "static/"],
    "api": ["routes/", "endpoints/", "api/", "controllers/", "handlers/"],
    "cli": ["cli.py", "main.py", "__main__.py", "bin/", "cmd/"],
    "library": ["src/lib/", "lib/", "setup.py", "pyproject.toml", "package.json"],
    "mobile": ["ios/", "android/", "App.tsx", "App.js"],
    "ml-project": ["notebooks/", "models/", "data/", "train.py", "model.py"],
    "monorepo": ["packages/", "apps/", "lerna.json", "pnpm-workspace.yaml"],
}
# Directory-name fragments that point to an architecture.
ARCHITECTURES = {
    "mvc": ["models/", "views/", "controllers/"],
    "clean-architecture": ["domain/", "usecases/", "infrastructure/", "presentation/"],
    "hexagonal": ["adapters/", "ports/", "core/"],
    "layered": ["services/", "repositories/", "controllers/"],
    "microservices": ["docker-compose", "kubernetes", "k8s/"],
    "serverless": ["serverless.yml", "lambda/", "functions/"],
}

# Manifest text to framework name.
PYTHON_MANIFESTS = ["requirements.txt", "requirements.in", "pyproject.toml", "setup.py"]
PYTHON_MANIFEST_FRAMEWORKS = {
    "fastapi": "FastAPI", "django": "Django", "flask": "Flask", "pytorch": "PyTorch", "torch": "PyTorch",
    "tensorflow": "TensorFlow", "pandas": "Pandas", "numpy": "NumPy", "scikit-learn": "scikit-learn",
    "celery": "Celery", "sqlalchemy": "SQLAlchemy", "pydantic": "Pydantic",
}
NODE_MANIFEST_FRAMEWORKS = {
    "react": "React", "next": "Next.js", "vue": "Vue", "angular": "Angular", "svelte": "Svelte", "express": "Express",
    "nestjs": "NestJS", "@nestjs/core": "NestJS", "tailwindcss": "Tailwind", "typescript": "TypeScript",
}
RUST_MANIFEST_FRAMEWORKS = {
    "actix": "Actix", "axum": "Axum", "tokio": "Tokio", "rocket": "Rocket", "warp": "Warp",
}
GO_MANIFEST_FRAMEWORKS = {"gin-gonic": "Gin", "echo": "Echo", "fiber": "Fiber"}

# Route declarations; group 1 is the method, group 2 the route.
ENDPOINT_PATTERNS = {
    "FastAPI": r"@(?:app|router)\.(get|post|put|patch|delete)\(['\"]([^'\"]+)['\"]",
    "Flask": r"@(?:app|blueprint)\.(route|get|post|put|delete)\(['\"]([^'\"]+)['\"]",
    "Express": r"(?:app|router)\.(get|post|put|patch|delete)\(['\"]([^'\"]+)['\"]",
}
# Which detected frameworks switch a route pattern on.
ENDPOINT_GATES = {"FastAPI": ["FastAPI"], "Flask": ["Flask"], "Express": ["Express", "NestJS"]}

# --- text rules ----------------------------------------------------------------------------------------------------------------
# Framework name to patterns, matched without regard to case.
FRAMEWORKS = {
    "Django": [r"from django", r"import django", r"INSTALLED_APPS", r"urlpatterns"],
    "Flask": [r"from flask", r"import flask", r"Flask\(__name__\)"],
    "FastAPI": [r"from fastapi", r"import fastapi", r"FastAPI\(\)"],
    "Starlette": [r"from starlette", r"import starlette"],
    "Tornado": [r"from tornado", r"import tornado"],
    "NumPy": [r"import numpy", r"from numpy"],
    "Pandas": [r"import pandas", r"from pandas"],
    "PyTorch": [r"import torch", r"from torch"],
    "TensorFlow": [r"import tensorflow", r"from tensorflow"],
    "Scikit-learn": [r"from sklearn", r"import sklearn"],
    "Keras": [r"from keras", r"import keras"],
    "pytest": [r"import pytest", r"from pytest"],
    "unittest": [r"import unittest", r"from unittest"],
    "React": [r"from ['\"]react['\"]", r"import React", r"useState", r"useEffect"],
    "Vue": [r"from ['\"]vue['\"]", r"createApp", r"<template>"],
    "Angular": [r"@angular/core", r"@Component", r"@Injectable"],
    "Svelte": [r"<script.*>", r"\.svelte$"],
    "Next.js": [r"from ['\"]next", r"getServerSideProps", r"getStaticProps"],
    "Express": [r"from ['\"]express['\"]", r"require\(['\"]express['\"]"],
    "NestJS": [r"@nestjs/", r"@Controller", r"@Injectable"],
    "Jest": [r"from ['\"]jest['\"]", r"describe\(", r"it\(", r"expect\("],
    "Mocha": [r"from ['\"]mocha['\"]", r"describe\(", r"it\("],
    "Vitest": [r"from ['\"]vitest['\"]"],
    "Gin": [r"github.com/gin-gonic/gin"],
    "Echo": [r"github.com/labstack/echo"],
    "Fiber": [r"github.com/gofiber/fiber"],
    "Actix": [r"actix-web", r"actix_web"],
    "Rocket": [r"rocket::"],
    "Axum": [r"axum::"],
    "Rails": [r"Rails\.", r"ActiveRecord", r"ActionController"],
    "Sinatra": [r"require ['\"]sinatra['\"]", r"Sinatra::"],
    "SQLAlchemy": [r"from sqlalchemy", r"import sqlalchemy"],
    "Prisma": [r"@prisma/client", r"prisma\."],
    "TypeORM": [r"from ['\"]typeorm['\"]"],
    "Sequelize": [r"from ['\"]sequelize['\"]"],
    "Mongoose": [r"from ['\"]mongoose['\"]"],
}

# Feature key to patterns, matched on lowercase text.
FEATURES = {
    "authentication": [
        r"auth", r"login", r"logout", r"signup", r"register", r"oauth", r"jwt", r"session", r"password", r"2fa",
        r"mfa", r"sso", r"saml", r"ldap", r"token",
    ],
    "payment": [
        r"payment", r"checkout", r"billing", r"invoice", r"subscription", r"stripe", r"paypal", r"charge", r"refund",
        r"transaction", r"pricing",
    ],
    "real_time": [
        r"websocket", r"socket\.io", r"realtime", r"real-time", r"live\s*update", r"push\s*notification", r"sse",
        r"pubsub", r"broadcast", r"channel",
    ],
    "search": [
        r"elasticsearch", r"solr", r"algolia", r"meilisearch", r"full.?text.?search", r"search.?index",
        r"fuzzy.?search",
    ],
    "file_upload": [
        r"upload", r"s3", r"blob", r"storage", r"presigned", r"multipart", r"file.?handling", r"asset",
    ],
    "email": [r"sendgrid", r"mailgun", r"ses", r"smtp", r"email.?template", r"newsletter", r"transactional"],
    "notifications": [r"notification", r"push", r"firebase.?cloud", r"fcm", r"apns", r"alert", r"in.?app.?message"],
    "caching": [r"redis", r"memcache", r"cache", r"memoiz", r"ttl", r"invalidat", r"cdn"],
    "queue": [
        r"celery", r"rq", r"bullmq", r"rabbitmq", r"sqs", r"background.?job", r"worker", r"task.?queue",
        r"async.?task",
    ],
    "api": [r"rest.?api", r"graphql", r"openapi", r"swagger", r"endpoint", r"rate.?limit", r"api.?version"],
    "database": [
        r"migration", r"schema", r"model", r"orm", r"query.?optim", r"index", r"foreign.?key", r"transaction",
        r"rollback",
    ],
    "ci_cd": [
        r"github.?action", r"jenkins", r"circleci", r"travis", r"deploy", r"pipeline", r"ci.?cd", r"docker",
        r"kubernetes", r"helm", r"terraform",
    ],
    "testing": [
        r"test.?suite", r"unit.?test", r"integration.?test", r"e2e", r"coverage", r"mock", r"fixture",
    ],
    "analytics": [
        r"analytics", r"tracking", r"metrics", r"dashboard", r"report", r"insight", r"visualization",
    ],
    "ml_ai": [
        r"machine.?learning", r"neural", r"train", r"model", r"predict", r"tensorflow", r"pytorch", r"sklearn",
        r"llm", r"gpt", r"embedding", r"vector",
    ],
    "scraping": [r"scrape", r"crawl", r"spider", r"beautifulsoup", r"selenium", r"playwright", r"puppeteer"],
    "security": [
        r"encrypt", r"decrypt", r"hash", r"salt", r"csrf", r"xss", r"sanitiz", r"vulnerability", r"permission",
        r"role.?based", r"rbac", r"acl",
    ],
}
# Feature key to title and skills.
FEATURE_INFO = {
    "authentication": ("Authentication system", ["Security", "OAuth", "JWT"]),
    "payment": ("Payment processing", ["Payment APIs", "PCI compliance"]),
    "real_time": ("Real-time communication", ["WebSockets", "Event-driven architecture"]),
    "search": ("Search functionality", ["Search engines", "Full-text search"]),
    "file_upload": ("File upload system", ["Cloud storage", "File handling"]),
    "email": ("Email system", ["Email APIs", "Template systems"]),
    "notifications": ("Notification system", ["Push notifications", "Real-time updates"]),
    "caching": ("Caching layer", ["Redis", "Performance optimization"]),
    "queue": ("Background job system", ["Message queues", "Async processing"]),
    "api": ("API development", ["REST API", "API design"]),
    "database": ("Database design", ["Database design", "SQL", "ORM"]),
    "ci_cd": ("CI/CD pipeline", ["DevOps", "CI/CD", "Docker"]),
    "testing": ("Test suite", ["Testing", "TDD"]),
    "analytics": ("Analytics system", ["Data analysis", "Visualization"]),
    "ml_ai": ("ML/AI features", ["Machine Learning", "AI"]),
    "scraping": ("Web scraping", ["Web scraping", "Data extraction"]),
    "security": ("Security implementation", ["Security", "Encryption"]),
}

# Vendor name to patterns, matched on lowercase text.
INTEGRATIONS = {
    "Stripe": [r"stripe", r"sk_live", r"pk_live"],
    "PayPal": [r"paypal", r"braintree"],
    "Square": [r"square", r"squareup"],
    "AWS": [r"aws", r"boto3", r"s3", r"ec2", r"lambda", r"dynamodb", r"sqs", r"sns"],
    "Google Cloud": [r"gcp", r"google.cloud", r"bigquery", r"firestore"],
    "Azure": [r"azure", r"microsoft.azure"],
    "Vercel": [r"vercel", r"@vercel"],
    "Cloudflare": [r"cloudflare", r"cf-"],
    "PostgreSQL": [r"postgres", r"psycopg", r"pg_"],
    "MongoDB": [r"mongodb", r"mongoose", r"pymongo"],
    "Redis": [r"redis", r"ioredis"],
    "Elasticsearch": [r"elasticsearch", r"elastic.co"],
    "Twilio": [r"twilio"],
    "SendGrid": [r"sendgrid"],
    "Mailgun": [r"mailgun"],
    "Slack": [r"slack", r"slack-sdk"],
    "Discord": [r"discord", r"discord.py"],
    "Auth0": [r"auth0"],
    "Firebase Auth": [r"firebase.auth", r"firebase/auth"],
    "Okta": [r"okta"],
    "Clerk": [r"@clerk"],
    "Supabase": [r"supabase"],
    "OpenAI": [r"openai", r"gpt-4", r"gpt-3"],
    "Anthropic": [r"anthropic", r"claude"],
    "Hugging Face": [r"huggingface", r"transformers"],
    "LangChain": [r"langchain"],
    "Segment": [r"segment", r"analytics.js"],
    "Mixpanel": [r"mixpanel"],
    "Amplitude": [r"amplitude"],
    "PostHog": [r"posthog"],
    "Sentry": [r"sentry", r"@sentry"],
    "Datadog": [r"datadog", r"dd-trace"],
    "New Relic": [r"newrelic"],
    "GitHub API": [r"github.api", r"octokit", r"pygithub"],
    "Shopify": [r"shopify"],
    "Contentful": [r"contentful"],
    "Algolia": [r"algolia", r"algoliasearch"],
}

# Scale group to patterns, matched on lowercase text.
SCALE = {
    "high_traffic": [
        r"rate.?limit", r"throttl", r"load.?balanc", r"horizontal.?scal", r"replica", r"shard", r"partition",
        r"concurrent",
    ],
    "data_intensive": [
        r"batch.?process", r"etl", r"pipeline", r"stream", r"million", r"billion", r"terabyte", r"petabyte",
    ],
    "performance": [
        r"optimi[zs]", r"latency", r"throughput", r"benchmark", r"profil", r"memory.?leak", r"garbage.?collect",
    ],
    "reliability": [
        r"fault.?toleran", r"failover", r"redundan", r"backup", r"disaster.?recovery", r"high.?availability", r"sla",
    ],
}

# Domain name to patterns, matched on lowercase text.
DOMAINS = {
    "e-commerce": [r"shop", r"cart", r"checkout", r"product", r"inventory", r"order"],
    "fintech": [r"payment", r"banking", r"transaction", r"wallet", r"financial"],
    "healthcare": [r"patient", r"medical", r"health", r"doctor", r"appointment"],
    "education": [r"course", r"student", r"lesson", r"quiz", r"learning"],
    "social": [r"post", r"comment", r"follow", r"friend", r"feed", r"like"],
    "productivity": [r"task", r"project", r"calendar", r"reminder", r"schedule"],
    "media": [r"video", r"stream", r"playlist", r"podcast", r"audio"],
    "developer-tools": [r"cli", r"sdk", r"api", r"framework", r"library"],
    "real-estate": [r"property", r"listing", r"agent", r"rent", r"tenant"],
    "travel": [r"booking", r"hotel", r"flight", r"destination", r"itinerary"],
    "food": [r"restaurant", r"menu", r"delivery", r"recipe", r"order"],
    "fitness": [r"workout", r"exercise", r"gym", r"fitness", r"health"],
    "analytics": [r"dashboard", r"metric", r"report", r"insight", r"chart"],
}

# --- commit messages -------------------------------------------------------------------------------------------------------------
# Subjects holding one of these are no achievements.
SUBJECT_STOP_WORDS = [
    "merge", "update readme", "fix typo", "wip", "temp", "clean up", "formatting", "lint", "bump version",
]
# What an achievement reads like; group 1 is the achievement.
ACHIEVEMENT_PATTERNS = [
    r"implement(?:ed|s)?\s+(.+)", r"add(?:ed|s)?\s+(.+)", r"create(?:d|s)?\s+(.+)", r"build(?:s)?\s+(.+)",
    r"introduc(?:e|ed|es)\s+(.+)", r"develop(?:ed|s)?\s+(.+)", r"design(?:ed|s)?\s+(.+)",
    r"integrat(?:e|ed|es)\s+(.+)", r"migrat(?:e|ed|es)\s+(.+)", r"optimi[zs](?:e|ed|es)\s+(.+)",
    r"refactor(?:ed|s)?\s+(.+)", r"fix(?:ed|es)?\s+(.+)", r"improv(?:e|ed|es)\s+(.+)",
]
# Change type letter to label; any other letter is "Changed".
CHANGE_LABELS = {"A": "Added", "D": "Deleted", "M": "Modified", "R": "Renamed"}

"""Rules as data: languages, layers, architecture signals, roles, capabilities, risks and weights."""

from __future__ import annotations

#: Languages by file extension.
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "py": "python", "java": "java", "cs": "csharp", "go": "go", "rs": "rust", "rb": "ruby", "php": "php", "swift": "swift",
    "kt": "kotlin", "kts": "kotlin", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "h": "c", "c": "c",
}
#: Extensions tried when a specifier is resolved.
RESOLVE_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
#: Ignored names and paths.
DEFAULT_IGNORE = (
    "node_modules", ".git", "dist", "build", "out", ".next", ".nuxt", "coverage", ".turbo", "__pycache__", ".pytest_cache", "target", "bin", "obj",
    ".vscode", ".idea", "*.min.js", "*.min.css", "*.map", "*.lock", "package-lock.json", "pnpm-lock.yaml", "yarn.lock",
)
MAX_FILE_SIZE = 1_000_000
#: Layer of a path segment; the first role in this order that a path bears holds.
LAYERS = (
    ("test", ("test", "tests", "__tests__", "spec", "specs")),
    ("config", ("config", "configuration")),
    ("presentation", ("presentation", "controllers", "controller", "views", "view", "ui", "web", "api")),
    ("application", ("application", "services", "service", "use-cases", "usecases", "interactors")),
    ("domain", ("domain", "entities", "entity", "aggregates", "aggregate", "value-objects", "valueobjects", "ports")),
    ("infrastructure", ("infrastructure", "adapters", "adapter", "persistence", "data", "repositories", "repository", "dao")),
    ("shared", ("shared", "common", "utils", "utilities")),
)
#: Signals of a pattern: (pattern, rule, weight, source segments, target segments or None).
SIGNALS = (
    ("mvc", "mvc.models", 0.27, ("models", "model"), None),
    ("mvc", "mvc.views", 0.27, ("views", "view", "templates"), None),
    ("mvc", "mvc.controllers", 0.3, ("controllers", "controller"), None),
    ("clean", "clean.domain", 0.28, ("domain", "entities", "use-cases"), None),
    ("clean", "clean.application", 0.24, ("application", "use-cases", "interactors"), None),
    ("clean", "clean.infrastructure", 0.24, ("infrastructure", "adapters", "persistence"), None),
    ("clean", "clean.presentation", 0.14, ("presentation", "controllers", "api"), None),
    ("clean", "clean.dependencyDirection", 0.08, ("presentation", "infrastructure", "adapters"), ("application", "domain", "use-cases")),
    ("hexagonal", "hexagonal.ports", 0.36, ("ports", "port"), None),
    ("hexagonal", "hexagonal.adapters", 0.36, ("adapters", "adapter", "driving", "driven"), None),
    ("hexagonal", "hexagonal.domain", 0.18, ("domain", "core"), None),
    ("hexagonal", "hexagonal.dependencyDirection", 0.08, ("adapters", "infrastructure"), ("ports", "domain", "core")),
    ("ddd", "ddd.entities", 0.2, ("entities", "entity"), None),
    ("ddd", "ddd.valueObjects", 0.22, ("value-objects", "valueobjects", "value-object"), None),
    ("ddd", "ddd.aggregates", 0.25, ("aggregates", "aggregate"), None),
    ("ddd", "ddd.repositories", 0.2, ("repositories", "repository"), None),
    ("ddd", "ddd.contexts", 0.18, ("bounded-contexts", "boundedcontexts", "contexts"), None),
    ("layered", "layered.presentation", 0.27, ("presentation", "controllers", "ui", "web"), None),
    ("layered", "layered.business", 0.27, ("business", "services", "service", "application"), None),
    ("layered", "layered.data", 0.27, ("data", "persistence", "repositories", "dao"), None),
    ("layered", "layered.dependencyDirection", 0.08, ("presentation", "controllers", "application", "services"), ("business", "data", "persistence", "repositories")),
    ("microservice", "microservice.gateway", 0.2, ("gateway", "api-gateway", "apigateway"), None),
    ("microservice", "microservice.messaging", 0.12, ("events", "messaging", "queues", "pubsub"), None),
)
#: Weight of two, and of three or more, service areas.
SERVICE_WEIGHTS = (0.45, 0.62)
MAX_CONFIDENCE, MIN_CONFIDENCE = 0.98, 0.35
#: Order of patterns of equal confidence.
PATTERN_ORDER = ("hexagonal", "clean", "ddd", "mvc", "microservice", "layered")
#: Top-level directories that aren't domains.
NO_DOMAINS = ("node_modules", "dist", "build", ".git", ".github", ".vscode", "coverage", "__tests__", "test", "tests", "scripts", "config", "configs", ".turbo", ".cache", "_root")
#: Role of a file by parts of its path, then by parts of its name.
ROLE_PATHS = (
    ("controller", ("/controllers/", "/controller/")), ("service", ("/services/", "/service/")), ("repository", ("/repositories/", "/repository/", "/repo/")),
    ("model", ("/models/", "/model/", "/entities/")), ("view", ("/views/", "/components/", "/pages/")), ("middleware", ("/middleware/", "/middlewares/")),
    ("utility", ("/utils/", "/helpers/", "/lib/")),
)
ROLE_NAMES = (
    ("controller", ("controller",)), ("service", ("service",)), ("repository", ("repository", "repo")), ("model", ("model", "entity", "schema")),
    ("middleware", ("middleware",)), ("utility", ("util", "helper")),
)
#: What a file of each role is for; {} is its name without extension.
PURPOSES = {
    "controller": "Handles incoming requests for {}", "service": "Business logic for {}", "repository": "Data access for {}", "model": "Data model definition for {}",
    "view": "UI component for {}", "middleware": "Request middleware for {}", "utility": "Utility functions for {}", "config": "Configuration for {}", "test": "Test suite for {}",
    "type-definition": "Type definitions for {}", "entry-point": "Module entry point for {}", "barrel": "Barrel re-export for {}", "unknown": "Module {}",
}
#: Capabilities: (name, category, framework names, import names, pattern of paths).
CAPABILITIES = (
    ("REST API Serving", "api", ("express", "fastify", "koa", "hono"), (), "routes?|endpoints?|controllers?"),
    ("GraphQL API", "api", ("graphql", "apollo"), ("graphql",), r"schema\.graphql|resolvers?"),
    ("SQL Database Access", "database", ("prisma", "typeorm", "sequelize", "drizzle", "knex"), (), r"migrations?|\.sql$"),
    ("Authentication", "authentication", ("passport",), ("jsonwebtoken", "bcrypt"), "auth|login|signup|session"),
    ("Caching", "caching", ("redis", "ioredis"), ("lru-cache",), "cache"),
    ("File Storage", "storage", ("multer",), ("@aws-sdk/client-s3",), "upload|storage|bucket"),
    ("UI Rendering", "ui", ("react", "vue", "angular", "svelte"), (), "components?|pages?|views?"),
    ("Automated Testing", "testing", ("jest", "vitest", "mocha", "cypress", "playwright"), (), None),
    ("Logging", "logging", ("winston", "pino", "bunyan"), ("winston", "pino"), None),
    ("Task Scheduling", "scheduling", ("bull", "agenda"), ("node-cron",), "cron|scheduler|worker|queue"),
)
#: Frameworks told from dependency names, and their display names.
FRAMEWORKS = {
    "@angular/core": "Angular", "@nestjs/core": "NestJS", "@sveltejs/kit": "SvelteKit", "@vue/core": "Vue", "vue": "Vue", "express": "Express", "fastify": "Fastify",
    "next": "Next.js", "nuxt": "Nuxt", "react": "React", "svelte": "Svelte",
}
#: Weights of severities and of health dimensions.
SEVERITY_WEIGHTS = {"info": 1, "low": 2, "medium": 4, "high": 7, "critical": 10}
HEALTH_WEIGHTS = {"architecture": 0.25, "dependency": 0.2, "complexity": 0.25, "knowledge": 0.15, "risk": 0.15}
EXPOSURE_SCALE = 25
#: Order of edge types in a merge, and weights of impact components.
EDGE_PRIORITY = {"dynamic-import": 1, "type-import": 2, "re-export": 3, "require": 4, "import": 5}
IMPACT_WEIGHTS = {"reach": 0.35, "critical": 0.25, "domain": 0.15, "risk": 0.15, "boundary": 0.1}

#: Metrics of a version, by name.
SNAPSHOT_METRICS = (
    "health.overall health.architecture health.dependency health.complexity health.knowledge health.risk complexity.average complexity.max complexity.instability "
    "risk.overall risk.total risk.critical entities.total modules.total domains.total capabilities.total knowledge.total critical.total duration.ms"
).split()
#: Weights of entities, domains and health in a change's significance, and the health points that count in full.
SIGNIFICANCE_WEIGHTS, SIGNIFICANT_HEALTH = (0.4, 0.3, 0.3), 20

#: What warnings call the collections of an impact.
IMPACT_LABELS = {"domain": "domains", "capability": "capabilities", "critical": "critical components", "risk": "risks", "layer": "architecture layers"}

#: Frameworks of a category, by parts of their names in lower case; the first category that fits holds.
FRAMEWORK_CATEGORIES = {
    "frontend": ("react", "vue", "angular", "svelte", "next", "nuxt"), "backend": ("express", "fastify", "koa", "nest", "hono", "django", "flask"),
    "testing": ("jest", "vitest", "mocha", "cypress", "playwright"), "build": ("webpack", "vite", "rollup", "esbuild", "turbo"), "orm": ("prisma", "typeorm", "sequelize", "drizzle"),
}
#: What a project is, by parts of its frameworks' names, in order of precedence.
PROJECT_TYPES = (("monorepo", ("turbo", "lerna", "nx")), ("service", ("express", "fastify", "koa", "nest", "hono")), ("application", ("react", "vue", "angular", "svelte", "next", "nuxt")))
#: Test frameworks in order of precedence; parts of the names of linters.
TEST_FRAMEWORKS = ("vitest", "jest", "mocha", "cypress", "playwright")
LINTERS = ("eslint", "prettier")
#: Description of a project by its type; {} is its first language.
DESCRIPTIONS = {
    "library": "A {} library", "application": "A {} application", "monorepo": "A {} monorepo", "framework": "A {} framework", "cli-tool": "A {} CLI tool",
    "plugin": "A {} plugin/extension", "service": "A {} service", "unknown": "A {} project",
}
DESCRIBED_PATTERN = "{} using {} architecture"
#: The sentences of the story. {} is filled in order; names that end with _one and _many go by a count.
STORY = {
    "project": "{} is a {} {}", "one_language": " written in {}", "languages_one": " written primarily in {} with {} additional language", "languages_many": " written primarily in {} with {} additional languages",
    "frameworks": ", using {}", "end": ".", "description": " {}.",
    "pattern": "Heuristic analysis matched a {} architecture", "match": " ({}% heuristic match)", "layers_one": " with {} layer: {}", "layers_many": " with {} layers: {}",
    "no_domains": "No distinct business domains were identified. The codebase may be a single-domain application or a library.",
    "domains_one": "The codebase contains {} identified business domain.", "domains_many": "The codebase contains {} identified business domains.",
    "no_health": "Heuristic health is unavailable because no source files were parsed.", "health": "Heuristic health: {}/100 ({}).", "concern": " Key concern: the {} heuristic signal is {}/100.",
    "no_critical": "No critical-severity components were identified.", "critical_one": "The critical path runs through {} component: {}.", "critical_many": "The critical path runs through {} components: {}.",
    "no_risks": "No risks were detected.", "risks_one": "{} risk detected (risk exposure: {}/100).", "risks_many": "{} risks detected (risk exposure: {}/100).",
    "critical_risks_one": "{} critical-severity risk requires immediate attention.", "critical_risks_many": "{} critical-severity risks require immediate attention.",
    "high_risks_one": "{} high-severity risk should be addressed in the near term.", "high_risks_many": "{} high-severity risks should be addressed in the near term.",
    "top_one": "{}: {} (affects {} file).", "top_many": "{}: {} (affects {} files).",
}
#: Least health of each rating, and the health below which a dimension is a concern.
HEALTH_RATINGS = ((85, "excellent"), (70, "good"), (50, "fair"), (30, "poor"))
CONCERN = 60

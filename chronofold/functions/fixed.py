"""Lists, patterns, weights and codes that results depend on."""

# -- fixed values: paths ------------------------------------------------------------------------------------
#: A whole segment, or any part of the path where the entry has a slash.
VENDORED = ["node_modules", "vendor", "third_party", "thirdparty", "external", "Pods", "bower_components", ".yarn/releases", ".yarn/plugins"]
GENERATED_SEGMENTS = ["dist", "generated", "build", "out", "target", "coverage", "__generated__", "__snapshots__", ".next", ".nuxt", "gen"]
GENERATED_PATTERNS = [
    r"\.min\.(?:js|css)$",
    r"\.(?:pb|generated|g)\.(?:go|ts|js|dart|py|cs)$",
    r"_pb2?\.py$",
    r"\.d\.ts\.map$",
    r"\.(?:map)$",
    r"\.(?:rs|py|go|js|ts|rb|java|c|cc|cpp|h|hpp)\.html?$",
    r"(?:^|[._-])generated(?:[._-]|$)",
]
LOCKFILES = [
    "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "npm-shrinkwrap.json", "bun.lockb", "Cargo.lock", "poetry.lock", "Pipfile.lock", "uv.lock",
    "composer.lock", "Gemfile.lock", "go.sum", "packages.lock.json", "flake.lock", "pubspec.lock", "mix.lock", "Podfile.lock", "gradle.lockfile",
]
TEST_SEGMENTS = ["test", "tests", "__tests__", "spec", "e2e"]
TEST_FILE = r"(?:[._-](?:test|spec)\.[a-z0-9]+$)|(?:^test_.*\.py$)|(?:_test\.go$)"
BINARY_EXTENSIONS = (
    "png jpg jpeg gif webp ico bmp tiff avif pdf zip gz tgz bz2 xz zst 7z rar jar woff woff2 ttf otf eot mp3 mp4 mov avi webm wav flac ogg "
    "so dylib dll exe bin o a wasm class pyc db sqlite sqlite3 lockb"
).split()
MANIFESTS = [
    "package.json", "Cargo.toml", "pyproject.toml", "requirements.txt", "go.mod", "Gemfile", "composer.json", "pom.xml", "build.gradle",
    "build.gradle.kts", "mix.exs", "pubspec.yaml", "Package.swift",
]
#: The classifier's list has one entry more than the one that significance uses.
CLASSIFIER_MANIFESTS = [*MANIFESTS, "setup.py"]
PUBLIC_API = ["index.ts", "index.js", "mod.rs", "lib.rs", "__init__.py", "index.d.ts", "api.ts", "public-api.ts"]
LANGUAGES = {
    "ts": "TypeScript", "tsx": "TypeScript", "mts": "TypeScript", "cts": "TypeScript", "js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript",
    "rs": "Rust", "py": "Python", "go": "Go", "rb": "Ruby", "java": "Java", "kt": "Kotlin", "swift": "Swift", "c": "C", "h": "C", "cc": "C++", "cpp": "C++", "hpp": "C++",
    "cs": "C#", "php": "PHP", "scala": "Scala", "ex": "Elixir", "exs": "Elixir", "sh": "Shell", "bash": "Shell", "zsh": "Shell", "sql": "SQL", "css": "CSS", "scss": "SCSS",
    "html": "HTML", "vue": "Vue", "svelte": "Svelte", "md": "Markdown", "json": "JSON", "yml": "YAML", "yaml": "YAML", "toml": "TOML",
}

# -- fixed values: messages ----------------------------------------------------------------------------------
MECHANICAL_TOOL = (
    r"\b(?:rustfmt|gofmt|goimports|clang-format|dos2unix|unix2dos|autopep8|yapf|ktlint|swiftformat|prettier|black|isort|eslint --fix|codemod|jscodeshift|2to3)\b"
)
MECHANICAL_VERB = (
    r"^(?:(?:style|chore|format|fmt|ci|build|refactor)(?:\([^)]*\))?!?:\s*)?(?:re-?format|re-?indent|reflow|apply\s+(?:formatting|the\s+formatter|code\s+style)"
    r"|run\s+(?:the\s+)?(?:formatter|linter|fmt)|normali[sz]e\s+(?:whitespace|line\s+endings|indentation|eol)|strip\s+trailing\s+whitespace"
    r"|fix\s+(?:up\s+)?(?:whitespace|indentation|line\s+endings|eol)|whitespace|convert\s+(?:tabs|crlf|line\s+endings)|bump\s+copyright|update\s+licen[cs]e\s+headers?)\b"
)
FIX_SUBJECT = r"^(?:fix|bugfix|hotfix|patch)\b|^fix[(:]|\bfix(?:es|ed)\b|\bbug\b|\bregression\b|\bcrash\b|\bhotfix\b"
REVERT_SUBJECT = r"^revert[:\s\x22]"
RELAND_SUBJECT = r"^re-?land\b|^reapply\b"
LOW_EFFORT = r"^(?:wip|fix|update|updates|changes|cleanup|misc|stuff|tmp|temp|minor|typo|\.+)$"
LOW_EFFORT_WIDE = r"^(?:wip|fix|fixes|fixed|update|updates|updated|changes|cleanup|misc|stuff|tmp|temp|test|minor|typo|\.+)$"
TRAILER_LINE = r"^([A-Za-z][A-Za-z0-9-]*)\s*:\s*(.+)$"

# -- fixed values: people ------------------------------------------------------------------------------------
MERGE_QUEUES = ["bors", "bors[bot]", "homu", "mergify", "mergify[bot]", "kodiakhq", "meeseeks", "rust highfive", "bulldozer", "craft", "autobot"]
BOT_EMAILS = [
    r"\[bot\]@",
    r"^(?:dependabot|renovate|greenkeeper|snyk-bot|imgbot|allcontributors)\b",
    r"@(?:dependabot|renovate)\b",
    r"^(?:actions|github-actions|gitlab-ci|jenkins|travis|circleci|buildkite)@",
    r"^noreply@github\.com$",
]
BOT_NAMES = [r"\[bot\]\s*$", r"^(?:dependabot|renovate|greenkeeper|snyk bot|imgbot)\b", r"^(?:github[- ]actions|gitlab ci|jenkins|travis ci|circleci)\b"]
NAME_SIMILARITY = 0.92
OVERLAP_SECONDS = 30 * 86_400
MERGE_SOURCES = ["mailmap", "exact-email", "normalized-email", "name-and-domain", "heuristic"]

# -- fixed values: flags and codes ---------------------------------------------------------------------------
COMMIT_FLAGS = {
    "merge": 1, "root": 2, "revert": 4, "reland": 8, "empty": 16, "signed": 32, "format-only": 64, "generated-only": 128, "vendored-only": 256,
    "lockfile-only": 512, "bulk-mechanical": 1024,
}
FILE_FLAGS = {"generated": 1, "vendored": 2, "test": 4, "binary": 8}
NON_SOURCE = 3
CHANGE_KINDS = ["add", "modify", "delete", "rename", "copy", "mode"]
HUNK_KINDS = ["content", "whitespace-only", "moved"]

# -- fixed values: scores ------------------------------------------------------------------------------------
BULK_FILES = 30
UNIFORMITY = 0.35
REPEATED_SUBJECT = 3
SATURATION_FILES = 50
SATURATION_CHURN = 2000
DAY = 86_400.0
DECAY_DAYS = 365.0
INACTIVE_DAYS = 183
LARGE_MERGE_FILES = 5
MIN_HOTSPOT_CHANGES = 2
COUPLING_MAX_FILES = 30
REWARDS = {
    "files": 0.8, "churn": 0.7, "quality": 1.5, "rarity": 1.2, "release": 1.6, "revert": 2.2, "manifest": 1.1, "public_api": 1.0, "new_dir": 1.4, "large_merge": 0.9,
}
PENALTIES = {"format-only": 4.0, "generated-only": 4.5, "vendored-only": 4.0, "lockfile-only": 5.0, "bulk-mechanical": 4.5}
BM25_K1 = 1.2
BM25_B = 0.75
RRF_K = 60

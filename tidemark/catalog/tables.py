"""Lookup tables. All of them are fixed values the results depend on."""

from __future__ import annotations

# --- check weights and categories; the weights add up to 100 ------------------
CHECKS = (
    # name, category, weight
    ("structure", "Foundations", 6),
    ("lint", "Foundations", 5),
    ("types", "Foundations", 6),
    ("type-safety", "Foundations", 3),
    ("standards", "Foundations", 3),
    ("complexity", "Quality", 5),
    ("duplication", "Quality", 3),
    ("error-handling", "Quality", 3),
    ("react", "Quality", 3),
    ("flutter", "Quality", 0),
    ("accessibility", "Quality", 4),
    ("docs", "Quality", 3),
    ("best-practices", "Quality", 3),
    ("html-quality", "Quality", 0),
    ("frontend-health", "Quality", 2),
    ("styling", "Quality", 1),
    ("env-validation", "Quality", 1),
    ("git-hygiene", "Quality", 1),
    ("memory-safety", "Quality", 1),
    ("testing", "Testing", 13),
    ("architecture", "Architecture", 5),
    ("performance", "Architecture", 4),
    ("container-health", "Architecture", 0),
    ("secrets", "Security", 6),
    ("security", "Security", 5),
    ("dependencies", "Security", 5),
    ("confusion", "Readability", 4),
    ("context", "Readability", 5),
)

# --- path policy ---------------------------------------------------------------
PRECEDENCE = {
    "security-sensitive": 10,
    "config-ignore": 20,
    "user-ignore": 30,
    "env-ignore": 31,
    "default-directory": 40,
    "default-file-pattern": 40,
    "generated-prefix": 41,
    "gitignore-directory": 50,
}
REASON_TOKENS = {
    "dependency": ("node_modules", "bower_components", "jspm_packages", ".pnpm-store", ".venv", "venv", "Pods", "vendor", "third_party"),
    "vcs": (".git", ".hg", ".svn"),
    "build-output": ("dist", "build", "out", "target", "obj", ".build", "DerivedData", ".next", ".nuxt", ".output", ".svelte-kit", ".astro", ".vite", "*.tsbuildinfo"),
    "test-output": ("coverage", "test-results", "playwright-report", "reports", "htmlcov", ".nyc_output", "coverage-final.json", "lcov.info", "junit.xml", "test-results.xml", ".coverage"),
    "framework-cache": (".dart_tool", ".flutter-plugins", ".gradle", ".angular", ".expo", ".wrangler", ".vercel", ".netlify", ".serverless", ".firebase", ".parcel-cache", ".turbo", ".nx", ".cache", ".yarn/cache", ".yarn/unplugged", ".yarn/build-state.yml", ".yarn/install-state.gz"),
    "agent-artifact": (".claude", ".gstack", ".playwright-mcp"),
    "runtime-cache": ("__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".tox", ".nox", ".hypothesis", ".provision"),
    "generated-file": ("screenshot-*.html", "*.snap.html", "*.snapshot.html", "*.bundle.js", "*.bundle.css", "*.chunk.js", "*.chunk.css", "*.min.js", "*.min.css", "*.generated.ts", "*.generated.tsx", "*.generated.js", "*.generated.jsx", "*.gen.ts", "*.gen.js", "*.g.dart", "*.pb.go", "*.designer.cs", "*.map"),
    "lockfile": ("pnpm-lock.yaml", "package-lock.json", "yarn.lock", "bun.lock", "bun.lockb", "pubspec.lock", "Podfile.lock", "Cargo.lock", "Gemfile.lock", "composer.lock"),
}
GENERATED_PREFIXES = (".claude/worktrees", ".yarn/cache", ".yarn/unplugged")
GENERATED_REASONS = ("agent-artifact", "build-output", "framework-cache", "generated-file", "runtime-cache", "test-output")
OVERRIDABLE_REASONS = ("config-ignore", "user-ignore", "env-ignore", "gitignore-directory")
# Tokens matched on the file name (or whole path) rather than on a directory segment.
FILE_PATTERNS = tuple(
    token
    for reason, tokens in REASON_TOKENS.items()
    for token in tokens
    if reason in ("generated-file", "lockfile")
    or token in ("*.tsbuildinfo", "coverage-final.json", "lcov.info", "junit.xml", "test-results.xml", ".coverage", ".yarn/build-state.yml", ".yarn/install-state.gz")
)
DIRECTORY_NAMES = tuple(
    token for tokens in REASON_TOKENS.values() for token in tokens if token not in FILE_PATTERNS and "/" not in token
)

# --- file kinds ------------------------------------------------------------------
SOURCE_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".dart", ".vue", ".svelte")
ASSET_EXTENSIONS = (".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".ico")
CONFIG_NAMES = (
    "package.json", "pubspec.yaml", "go.mod", "Cargo.toml", "pom.xml", "pyproject.toml",
    "tsconfig.json", "tsconfig.app.json", "tsconfig.base.json", "biome.json", "biome.jsonc",
    "eslint.config.js", "eslint.config.mjs", "eslint.config.cjs", "eslint.config.ts",
    ".eslintrc", ".eslintrc.json", ".eslintrc.js", ".eslintrc.cjs", ".eslintrc.yml", ".eslintrc.yaml",
    "analysis_options.yaml", "vite.config.ts", "vite.config.js", "vite.config.mjs", "vite.config.cjs",
    "astro.config.ts", "astro.config.js", "astro.config.mjs", "astro.config.cjs",
    "next.config.ts", "next.config.js", "next.config.mjs", "next.config.cjs",
    "vitest.config.ts", "vitest.config.js", "jest.config.js", "jest.config.ts",
    "go.work", "settings.gradle", "settings.gradle.kts", "build.gradle", "build.gradle.kts",
    "rush.json", "pants.toml", "BUILD", "BUILD.bazel", "wrangler.toml", "wrangler.json", "wrangler.jsonc",
    "pnpm-workspace.yaml", "package-lock.json",
)
MAX_SOURCE_BYTES = 1_000_000
REQUIRED_FILES = {
    "node": (
        ("package.json", True, "Package manifest"),
        ("tsconfig.json", False, "TypeScript configuration"),
        ("LICENSE", True, "Open source license"),
        (".gitignore", True, "Git ignore rules"),
        ("README.md", False, "Project documentation"),
    ),
    "dart": (
        ("pubspec.yaml", True, "Dart package manifest"),
        ("analysis_options.yaml", True, "Dart analysis options"),
        ("LICENSE", True, "Open source license"),
        (".gitignore", True, "Git ignore rules"),
        ("README.md", False, "Project documentation"),
    ),
}
ENTRYPOINTS = (
    "index.ts", "index.tsx", "index.js", "index.jsx", "main.ts", "main.tsx", "main.js", "main.dart",
    "cli.ts", "cli.js", "App.tsx", "App.ts", "App.vue", "App.svelte", "app.ts", "app.tsx", "app.dart",
    "+page.svelte", "+layout.svelte", "+server.ts", "page.tsx", "layout.tsx",
)
IMPORT_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".vue", ".svelte")
UNTESTED_NAMES = ("index", "main", "types", "constants", "config")

# --- naming ----------------------------------------------------------------------
SYNONYM_PAIRS = (
    ("utils", "helpers"), ("util", "helper"), ("types", "interfaces"), ("types", "models"),
    ("interfaces", "models"), ("constants", "config"), ("constants", "settings"), ("config", "settings"),
    ("service", "controller"), ("service", "handler"), ("controller", "handler"), ("store", "state"),
    ("context", "provider"),
)
GENERIC_NAMES = (
    "process", "handle", "run", "execute", "do", "perform", "make", "get", "set", "update", "create", "delete",
    "remove", "add", "data", "result", "item", "value", "info", "temp", "obj", "stuff", "thing", "ret", "val",
    "res", "output", "input", "response", "request", "payload", "body", "args", "params", "list", "arr", "map",
    "dict", "collection", "callback", "cb", "fn", "func", "handler",
)
AMBIGUOUS_ABBREVIATIONS = (
    "auth", "config", "env", "db", "msg", "ctx", "err", "mgr", "svc", "srv", "req", "res", "cmd", "evt", "ref",
)
STALE_REF_IGNORED = ("true", "false", "null", "undefined", "string", "number", "boolean", "json", "html", "css")

# --- fix suggestions: rule -> text, then (check, message part) -> text -----------
FIX_BY_RULE = {
    "empty-catch": "Add error logging: catch(e) { console.error(e); }",
    "throw-string": 'Replace throw "msg" with throw new Error("msg")',
    "swallowed-promise": "Add logging: .catch((e) => { console.error(e); })",
    "floating-promise": "Add await or .catch() to handle the promise",
    "unsafe-json-parse": "Wrap in try-catch: try { JSON.parse(x) } catch { /* handle */ }",
    "no-error-boundary": "Add <ErrorBoundary> wrapper in your React app root",
    "img-alt": 'Add alt attribute: <img alt="description" ...>',
    "click-events": 'Add role="button" and onKeyDown handler',
    "vue-v-for-key": 'Add :key="item.id" to the v-for element',
    "missing-key": "Add key={item.id} to the JSX element in .map()",
    "index-key": "Use a stable unique ID instead of array index for key",
    "conditional-hook": "Move the hook call before any conditional (if/switch)",
    "no-tests": "Create a test file: src/__tests__/example.test.ts",
    "no-readme": "Create README.md with: project description, install, usage",
    "no-changelog": "Create CHANGELOG.md or use changesets: npx changeset init",
    "env-not-ignored": "Add .env to .gitignore",
    "secret-detected": "Move to environment variable, rotate the exposed secret",
    "missing-lockfile": "Run: pnpm install (or npm install) to generate lockfile",
    "long-function": "Extract logic into smaller helper functions",
    "high-complexity": "Reduce nesting: use early returns, extract conditions",
    "duplicate-code": "Extract shared logic into a helper function",
    "circular-dep": "Extract shared types to a separate file both modules import",
    "god-module": "Split into focused interfaces — one responsibility per module",
    "process-exit": "Replace process.exit() with throw new Error()",
}
FIX_BY_MESSAGE = (
    # rule or None, check or None, message part, suggestion
    ("missing-file", None, "LICENSE", "Add LICENSE file: https://choosealicense.com/"),
    (None, "security", "innerHTML", "Use textContent or DOM APIs instead"),
    (None, "security", "eval", "Remove eval() — use a safer alternative"),
    (None, "security", "v-html", 'Sanitize with DOMPurify: v-html="DOMPurify.sanitize(input)"'),
)
AUTO_FIX_RULES = ("missing-file", "missing-lockfile", "ts-strict", "env-not-ignored", "no-ci")

# --- dependencies -----------------------------------------------------------------
HEAVY_PACKAGES = (
    ("moment", 300, "date-fns or dayjs (2-7KB)"),
    ("lodash", 70, "lodash-es or native methods"),
    ("lodash.js", 70, "lodash-es or native methods"),
    ("rxjs", 50, "only import operators you use"),
    ("@fortawesome/fontawesome-svg-core", 60, "lucide-react or heroicons (tree-shakeable)"),
    ("@material-ui/core", 300, "@mui/material with tree-shaking imports"),
    ("chart.js", 200, "lightweight-charts or uPlot"),
    ("firebase", 200, "firebase/app + only needed modules"),
    ("aws-sdk", 400, "@aws-sdk/client-* (v3 modular)"),
    ("underscore", 25, "native ES methods"),
    ("@angular/core", 500, "consider lighter framework if possible"),
    ("jquery", 90, "native DOM APIs or Alpine.js"),
    ("core-js", 150, "target modern browsers, use browserslist"),
    ("numeral", 30, "Intl.NumberFormat (built-in)"),
    ("date-fns", 40, "import only needed functions: date-fns/format"),
)
RUNTIME_CSS_PACKAGES = ("styled-components", "@emotion/styled", "@emotion/react")
UI_FRAMEWORKS = (
    ("@mui/material", "MUI"), ("@mui/system", "MUI"), ("@material-ui/core", "MUI"), ("tailwindcss", "Tailwind"),
    ("@chakra-ui/react", "Chakra"), ("antd", "Ant Design"), ("react-bootstrap", "Bootstrap"),
    ("bootstrap", "Bootstrap"), ("@mantine/core", "Mantine"), ("@radix-ui/react-dialog", "Radix"),
    ("@radix-ui/react-dropdown-menu", "Radix"), ("@radix-ui/themes", "Radix"), ("cmdk", "shadcn/ui"),
    ("vaul", "shadcn/ui"), ("daisyui", "DaisyUI"),
)
EXEMPT_FRAMEWORKS = ("Radix", "shadcn/ui", "DaisyUI")
ICON_LIBRARIES = (
    ("lucide", r"""from\s+["']lucide-(?:react|vue-next)["']"""),
    ("heroicons", r"""from\s+["']@heroicons/(?:react|vue)"""),
    ("fontawesome", r"""from\s+["']@fortawesome|fa-\w+"""),
    ("phosphor", r"""from\s+["']@phosphor-icons"""),
    ("tabler", r"""from\s+["']@tabler/icons"""),
    ("react-icons", r"""from\s+["']react-icons/"""),
    ("material-icons", r"""from\s+["']@mui/icons-material"""),
    ("ionicons", r"""from\s+["']ionicons|ion-icon"""),
)
COPYLEFT_LICENSES = (
    "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "AGPL-1.0",
    "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "EUPL-1.1",
    "EUPL-1.2", "SSPL-1.0", "CPAL-1.0", "OSL-3.0",
)
PERMISSIVE_LICENSES = (
    "MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "CC0-1.0", "Unlicense", "0BSD", "BlueOak-1.0.0", "Zlib",
)
SANITIZER_MODULES = (
    (r"^(?:isomorphic-)?dompurify$", "DOMPurify"),
    (r"^sanitize-html$", "sanitize-html"),
    (r"^xss$", "xss"),
    (r"^escape-html$", "escape-html"),
    (r"^he$", "he"),
    (r"^highlight\.js(?:/.*)?$", "highlight.js"),
    (r"^shiki(?:/.*)?$", "shiki"),
    (r"^prismjs(?:/.*)?$", "Prism"),
)

# --- component rule categories ------------------------------------------------------
RULE_CATEGORIES = {
    "conditional-hook": "hooks",
    "effect-no-deps": "effects",
    "missing-key": "rendering",
    "index-key": "rendering",
    "prop-spreading": "component-structure",
    "react-dangerous-html": "rendering",
    "react-dangerous-html-sanitized": "rendering",
    "inline-handlers": "component-structure",
    "direct-dom": "component-structure",
    "prefer-tailwind": "component-structure",
    "no-error-boundary": "error-boundary",
    "react-hooks/immutability": "compiler-readiness",
    "react-hooks/purity": "compiler-readiness",
    "react-hooks/globals": "compiler-readiness",
    "react-hooks/refs": "compiler-readiness",
    "react-hooks/set-state-in-render": "compiler-readiness",
    "react-hooks/preserve-manual-memoization": "compiler-readiness",
    "react-hooks/incompatible-library": "compiler-readiness",
    "react-hooks/unsupported-syntax": "compiler-readiness",
    "react-hooks/config": "compiler-readiness",
    "react-hooks/gating": "compiler-readiness",
    "react-hooks/exhaustive-deps": "effects",
    "react-hooks/set-state-in-effect": "effects",
    "react-hooks/no-deriving-state-in-effects": "effects",
    "react-hooks/exhaustive-effect-dependencies": "effects",
    "react-hooks/memoized-effect-dependencies": "effects",
    "react-hooks/error-boundaries": "error-boundary",
    "react-hooks/rules-of-hooks": "hooks",
    "react-hooks/hooks": "hooks",
    "react-hooks/capitalized-calls": "hooks",
    "react-hooks/component-hook-factories": "hooks",
    "react-hooks/static-components": "component-structure",
}
DETAIL_DENYLIST = ("assessment", "containerSvg", "graph", "reason", "skipped", "status", "toolRuns")

# --- style ---------------------------------------------------------------------------
STYLE_APPROACHES = (
    ("tailwind", r"""className\s*=\s*["'`][^"'`]*(?:flex|grid|p-|m-|text-|bg-|rounded|border|shadow|w-|h-)"""),
    ("css-modules", r"styles\.\w+|\.module\.css|\.module\.scss"),
    ("styled-components", r"styled\.\w+|styled\(|css`"),
    ("emotion", r"@emotion|css\s*\("),
    ("inline", r"style\s*=\s*\{\s*\{|style\s*=\s*\{[^}]"),
)
HARDCODED_COLOUR = r"""(?:color|backgroundColor|borderColor|fill|stroke)\s*:\s*['"]#[0-9a-fA-F]{3,8}"""
SPACING_PROPERTY = r"(?:margin|padding|gap|top|bottom|left|right|width|height|inset)\s*:\s*"
POOR_COMMIT_MESSAGE = r"^(?:fix|update|change|wip|test|stuff|asdf|temp|\.+)$"
BINARY_EXTENSIONS = (".zip", ".tar", ".gz", ".jar", ".war", ".exe", ".dll", ".so", ".dylib", ".bin", ".dat", ".sqlite", ".db")

# --- age labels and sparkline --------------------------------------------------------
SPARK_LEVELS = "▁▂▃▄▅▆▇█"
HISTORY_LENGTH = 30
CI_DEFAULT_THRESHOLD = 60

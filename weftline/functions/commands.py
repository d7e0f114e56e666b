"""What a call does, looked up by the name of its tool and by the first words of its commands.

A shell call is cut at its operators into commands; each gives the keys "program", "program word" and "program word
word". A key that stands in a table decides; of several commands the gravest action counts, in the order of ACTIONS.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tools whose target is a command line.
SHELL = "bash shell sh exec exec_command local_shell run_command run_terminal_cmd terminal".split()
#: Words before a command that do not name it.
PREFIXES = "sudo time env npx exec nohup command then do".split()

#: Actions from the gravest to the least; each with the command keys that mean it.
ACTIONS: dict[str, list[str]] = {
    "deploy": ["vercel deploy", "vercel --prod", "npm publish", "pnpm publish", "cargo publish", "twine upload", "fly deploy", "wrangler deploy", "wrangler publish", "kubectl apply", "helm upgrade", "helm install", "terraform apply", "firebase deploy", "netlify deploy", "docker push"],
    "ship": ["git push", "gh pr create", "gh pr merge"],
    "commit": ["git commit"],
    "test": ["vitest", "jest", "pytest", "tox", "rspec", "phpunit", "playwright test", "cypress run", "node --test", "cargo test", "go test", "mix test", "npm test", "npm t", "npm run test", "pnpm test", "pnpm run test", "yarn test", "yarn run test", "python -m pytest", "python -m unittest", "mvn test", "gradle test", "make test"],
    "typecheck": ["tsc", "vue-tsc", "typecheck", "mypy", "pyright", "npm run typecheck", "npm run type-check", "pnpm typecheck", "pnpm type-check", "yarn typecheck", "cargo check", "go vet"],
    "lint": ["eslint", "ruff", "flake8", "pylint", "prettier --check", "biome check", "cargo clippy", "golangci-lint run", "npm run lint", "pnpm lint", "pnpm run lint", "yarn lint", "make lint"],
    "build": ["next build", "vite build", "tsup", "webpack", "cargo build", "go build", "make", "npm run build", "pnpm build", "pnpm run build", "yarn build", "yarn run build", "docker build", "mvn package", "gradle build"],
    "install": ["npm i", "npm install", "npm ci", "pnpm i", "pnpm install", "pnpm add", "yarn add", "yarn install", "pip install", "python -m pip", "brew install", "uv add", "uv pip", "cargo add", "apt-get install"],
    "edit": [],
    "delegate": [],
    "read": ["cat", "sed -n", "head", "tail", "less", "bat", "nl"],
    "search": ["rg", "grep", "find", "ls", "fd", "wc", "tree", "git grep"],
    "git_read": ["git log", "git show", "git diff", "git status", "git blame", "git branch", "gh pr view", "gh pr list", "gh pr diff", "gh pr checks", "gh run view", "gh run list", "gh issue view", "gh issue list"],
    "web": ["curl", "wget"],
    "mcp": [],
}
#: Actions of tools that are no shell, by the tool's name in lower case.
TOOLS: dict[str, list[str]] = {
    "edit": "edit write multiedit notebookedit apply_patch filechange".split(),
    "delegate": "agent task workflow sendmessage spawn_agent".split(),
    "read": ["read"],
    "search": "grep glob ls toolsearch websearch".split(),
    "web": ["webfetch"],
}
#: Parts of tool names that mean a browser, and the tool of a data base.
BROWSER, SQL_TOOL = ("browser", "playwright", "navigate", "screenshot"), "execute_sql"
#: Lane of an action; calls without an entry are runs.
LANES = {"deploy": "ship", "ship": "ship", "commit": "ship", "test": "check", "typecheck": "check", "lint": "check", "edit": "change", "delegate": "delegate", "read": "probe", "search": "probe", "git_read": "probe"}
PROBE_TOOLS = ("webfetch", "skill")


def command_keys(target: Column) -> Column:
    """The keys of every command of a command line."""
    named = lambda w: (w != "") & ~w.isin(*PREFIXES) & ~w.rlike("^[a-z_]+=")
    words = F.transform(F.split(target, r"&&|\|\||[;|\n]"), lambda s: F.filter(F.split(F.lower(s), r"[ \t]+"), named))
    return F.flatten(F.transform(words, lambda w: F.array(*[F.array_join(F.slice(w, 1, n), " ") for n in (1, 2, 3)])))


def action_of(tool: Column, target: Column) -> Column:
    """The action of a call, 'run' where no table knows it."""
    name, keys = F.lower(tool), command_keys(F.coalesce(target, F.lit("")))
    shell = F.coalesce(name.isin(*SHELL), F.lit(False))
    case = None
    for action, commands in ACTIONS.items():
        hits = [shell & F.arrays_overlap(keys, F.array(*map(F.lit, commands)))] if commands else []
        if action in TOOLS:
            hits.append(name.isin(*TOOLS[action]))
        if action == "web":
            hits += [F.contains(name, F.lit(p)) for p in BROWSER]
        if action == "mcp":
            hits.append(F.contains(name, F.lit("__")))
        hit = hits[0]
        for h in hits[1:]:
            hit = hit | h
        hit = F.coalesce(hit, F.lit(False))
        case = F.when(hit, action) if case is None else case.when(hit, action)
    return case.otherwise("run")


def lane_of(tool: Column, target: Column, action: Column) -> Column:
    """probe, change, delegate, check, ship or run; a data base's tool probes where it only selects."""
    name = F.coalesce(F.lower(tool), F.lit(""))
    codes = F.create_map(*[F.lit(x) for kv in LANES.items() for x in kv])
    browser = F.contains(name, F.lit(BROWSER[0]))
    for p in BROWSER[1:]:
        browser = browser | F.contains(name, F.lit(p))
    selects = F.lower(F.trim(target)).rlike("^(select|with|explain)[^a-z]")
    return (
        F.when(browser, "check").when(F.contains(name, F.lit(SQL_TOOL)), F.when(selects, "probe").otherwise("change"))
        .when(name.isin(*PROBE_TOOLS), "probe").otherwise(F.coalesce(F.try_element_at(codes, action), F.lit("run")))
    )


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def action_sql() -> str:
    """``action_of`` over columns tool and target as SQL text."""
    keys = (
        "flatten(list_transform(list_transform(string_split_regex(coalesce(target, ''), '&&|\\|\\||[;|\\n]'), lambda s: list_filter(string_split_regex(lower(s), '[ \\t]+'), "
        f"lambda w: w <> '' AND NOT list_contains({_list(PREFIXES)}, w) AND NOT regexp_matches(w, '^[a-z_]+='))), lambda w: [array_to_string(w[1:1], ' '), array_to_string(w[1:2], ' '), array_to_string(w[1:3], ' ')]))"
    )
    arms = []
    for action, commands in ACTIONS.items():
        hits = [f"(list_contains({_list(SHELL)}, lower(tool)) AND list_has_any({keys}, {_list(commands)}))"] if commands else []
        hits += [f"list_contains({_list(TOOLS[action])}, lower(tool))"] if action in TOOLS else []
        hits += [f"contains(lower(tool), '{p}')" for p in BROWSER] if action == "web" else []
        hits += ["contains(lower(tool), '__')"] if action == "mcp" else []
        arms.append(f"WHEN {' OR '.join(hits)} THEN '{action}'")
    return f"CASE {' '.join(arms)} ELSE 'run' END"


def lane_sql() -> str:
    """``lane_of`` over columns tool, target and action as SQL text."""
    browser = " OR ".join(f"contains(lower(tool), '{p}')" for p in BROWSER)
    arms = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in LANES.items())
    return f"CASE WHEN {browser} THEN 'check' WHEN contains(lower(tool), '{SQL_TOOL}') THEN CASE WHEN regexp_matches(lower(trim(target)), '^(select|with|explain)[^a-z]') THEN 'probe' ELSE 'change' END WHEN list_contains({_list(PROBE_TOOLS)}, lower(tool)) THEN 'probe' ELSE CASE action {arms} ELSE 'run' END END"

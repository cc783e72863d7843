"""python -m cairnmill create NAME FOLDER | sync NAME | serve NAME | status [NAME] | search NAME QUESTION | ask NAME QUESTION
| config show NAME | config set-embedding NAME PROVIDER MODEL [URL [DIMENSION]] | config set-extraction NAME PROVIDER MODEL [URL] | models URL"""

from __future__ import annotations

import json
import os
import sys
from pathlib import Path

from cairnmill import server, settings
from cairnmill.api import Config, Project, to_json
from cairnmill.session import local_session
from cairnmill.sources.providers import discover


def registry_file() -> Path:
    return Path(os.environ.get("CAIRNMILL_HOME", Path.home() / ".cairnmill")) / "projects.json"


def projects() -> dict[str, str]:
    """Project names and folders; an unreadable registry counts as empty."""
    try:
        got = json.loads(registry_file().read_text())
    except (OSError, ValueError):
        return {}
    return got if isinstance(got, dict) else {}


def configure(args: list[str]) -> int:
    if len(args) < 2 or args[1] not in projects():
        print(__doc__, file=sys.stderr)
        return 2
    root = projects()[args[1]]
    have = settings.load(root)
    if args[0] == "show" and len(args) == 2:
        print(settings.dump(have) if have else "not configured", end="" if have else "\n")
        return 0
    have = have or settings.Settings(settings.Embedding())
    if args[0] == "set-embedding" and 4 <= len(args) <= 6:
        have.embedding = settings.Embedding(args[2], args[3], *args[4:5], **({"dimension": int(args[5])} if len(args) == 6 else {}))
    elif args[0] == "set-extraction" and 4 <= len(args) <= 5:
        have.extraction = settings.Extraction(args[2], args[3], *args[4:5])
    else:
        print(__doc__, file=sys.stderr)
        return 2
    settings.save(root, have)
    return 0


def main(args: list[str]) -> int:
    if len(args) == 3 and args[0] == "create":
        registry_file().parent.mkdir(parents=True, exist_ok=True)
        registry_file().write_text(json.dumps(projects() | {args[1]: str(Path(args[2]).resolve())}, indent=1))
        return 0
    if args[:1] == ["config"]:
        return configure(args[1:])
    if args == ["status"]:
        print(json.dumps(projects(), ensure_ascii=False))
        return 0
    if len(args) == 2 and args[0] == "models":
        print(json.dumps(discover(args[1]), ensure_ascii=False))
        return 0
    if len(args) < 2 or args[0] not in ("sync", "serve", "status", "search", "ask") or args[1] not in projects():
        print(__doc__, file=sys.stderr)
        return 2
    root = projects()[args[1]]
    have = settings.load(root)
    p = Project(local_session(), f"{root}/.cairnmill", have.config() if have else Config())
    if args[0] == "sync":
        out = p.sync(root)
    elif args[0] == "serve":
        p.sync(root)
        server.serve(p, sys.stdin, sys.stdout)
        p.stop()
        return 0
    elif args[0] == "status":
        out = p.status() | {"settings": settings.dump(have) if have else None}
    elif args[0] == "search":
        out = to_json(p.search_hybrid(" ".join(args[2:])))
    else:
        out = p.query_ontological(" ".join(args[2:]))
    print(json.dumps(out, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

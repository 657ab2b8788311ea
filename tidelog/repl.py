"""One statement a line: ``python -m tidelog.repl FOLDER``."""

from __future__ import annotations

import sys

from tidelog.plans.engine import Engine
from tidelog.session import session


def main(path: str) -> None:
    engine = Engine(session("local[*]"), path)
    for line in sys.stdin:
        if line.strip().lower() in ("exit", "quit"):
            break
        if line.strip():
            try:
                print(engine.execute(line))
            except (ValueError, LookupError) as e:
                print(f"Error: {e}")


if __name__ == "__main__":
    main(sys.argv[1])

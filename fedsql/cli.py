"""``python -m fedsql.cli script.sql``: a file, standard input, or a prompt."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from fedsql.engine import Engine
from fedsql.plans.lexer import SqlError


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("script", nargs="?")
    p.add_argument("arguments", nargs="*", help="given to the script as @arg1, @arg2 ...")
    p.add_argument("--config", action="append", default=[], help="YAML or JSON settings")
    p.add_argument("--pyeval", action="store_true", help="allow Python code in scripts")
    own = p.parse_args(args)
    engine = Engine(pyeval=own.pyeval, config=Engine.load_config(*own.config))
    for i, a in enumerate(own.arguments, 1):
        engine.set_variable(f"arg{i}", a)

    def run(text: str) -> None:
        df = engine.execute(text)
        if df is not None:
            df.show(1000, truncate=False)

    try:
        if own.script:
            run(Path(own.script).read_text())
        elif not sys.stdin.isatty():
            run(sys.stdin.read())
        else:
            waiting = ""
            while True:
                try:
                    waiting += input("sql> " if not waiting else "...> ") + "\n"
                except EOFError:
                    break
                if waiting.strip().lower() in ("exit", "quit"):
                    break
                if waiting.startswith("%cd "):
                    engine.session.base = str(Path(engine.session.base or ".", waiting[4:].strip()).resolve())
                    waiting = ""
                    continue
                if waiting.rstrip().endswith(";"):
                    try:
                        run(waiting)
                    except SqlError as e:
                        print(e, file=sys.stderr)
                    waiting = ""
    except SqlError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())

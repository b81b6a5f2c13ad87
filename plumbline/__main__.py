"""python -m plumbline COMMAND ROOT [ARGUMENT ...]: read and write commands of a mine.

Exit codes: 0 all right, 1 the mine does not fit, 2 refused or misused.
"""

from __future__ import annotations

import json
import locale
import re
import sys

from .commit import Refusal
from .core.state import Refused

#: Command: (least arguments, most arguments, options).
COMMANDS = {
    "validate": (0, 0, {"--json"}),
    "census": (0, 0, set()),
    "scope": (0, 0, {"--json"}),
    "pull": (1, 1, set()),
    "impact": (1, 1, set()),
    "gaps": (0, 1, set()),
    "status": (0, 0, {"--open"}),
    "reindex": (0, 0, {"--check"}),
    "retag": (2, 2, {"--dry"}),
    "attest": (4, 10_000, set()),
    "intake": (0, 2, {"--no-source", "--anchor-existing"}),
    "alloc": (1, 1, set()),
    "conflict": (1, 2, set()),
    "seal-review": (1, 1, set()),
    "consecrate": (1, 1, set()),
    "upgrade": (0, 0, {"--check", "--apply"}),
    "lang": (0, 0, set()),
    "locale": (0, 0, set()),
    "quotes": (0, 0, set()),
    "version": (0, 0, set()),
}


def checked(argv: list[str]) -> tuple[str, str, list[str], set[str]]:
    """(command, root, arguments, options); anything unknown or too much is refused before anything is read."""
    if len(argv) < 2 or argv[0] not in COMMANDS:
        raise Refusal("usage: " + (__doc__ or "").splitlines()[0])
    command, root, *rest = argv
    least, most, known = COMMANDS[command]
    options = {x for x in rest if x.startswith("--")}
    arguments = [x for x in rest if not x.startswith("--")]
    if options - known:
        raise Refusal(f"{command} has no option {sorted(options - known)[0]}")
    if not least <= len(arguments) <= most:
        raise Refusal(f"{command} takes {least} to {most} arguments")
    return command, root, arguments, options


def run(spark, argv: list[str], say=print) -> int:
    """Runs one command and gives its exit code."""
    try:
        return _run(spark, *checked(argv), say)
    except (Refusal, Refused, OSError, ValueError, re.error) as e:
        say(f"refused: {e}")
        return 2


def _run(spark, command, root, arguments, options, say) -> int:
    from .commit import upgrade, writers
    from .plans import commands
    from .sources.mine import MineError, open_mine

    if command == "version":
        say(f"fingerprint {commands.fingerprint()}")
        return 0
    if command == "locale":
        say(str(locale.getlocale()[0]))
        return 0
    if command == "upgrade":
        todo = upgrade.upgrade(spark, root, apply="--apply" in options)
        say(f"keep {len(todo.keep)} · delete {len(todo.delete)} · move {len(todo.move)} into {len(todo.entries)} · blocked {len(todo.blocks)}")
        return int(bool(todo.blocks))
    try:
        mine = open_mine(spark, root)
    except MineError as e:
        say(str(e))
        return 1
    if command == "validate":
        got = commands.validate(mine)
        if "--json" in options:
            say(json.dumps(got, ensure_ascii=False))
        else:
            for kind in ("diagnostics", "warnings"):
                for d in got[kind]:
                    say(f"{'warning: ' * (kind == 'warnings')}[{d['code']}] {d['message']}")
            e = got["examined"]
            say(f"examined: materials {e['materials']} · truths {e['truths']} ({e['sealed']} sealed, {e['failed']} failed, {e['not_checked']} not checked) · documents {e['documents']} ({e['consecrated']} consecrated, {e['gate_checked']} gate-checked)")
            say(got["result"])
        return int(got["result"] != "ok")
    if command == "scope":
        found = {f"{f} {c}": n for (f, c), n in sorted(commands.scope_counts(mine).items())}
        owed = [r.id for r in commands.scope(mine).where("evidence IN ('unverified', 'stale', 'failed')").orderBy("family", "id").collect()]
        say(json.dumps({"output_schema_version": 1, "classes": found, "owed": owed, "ghosts": commands.ghosts(mine)}, ensure_ascii=False) if "--json" in options else "\n".join([*(f"{k}: {n}" for k, n in found.items()), "owed: " + ", ".join(owed)]))
    elif command == "pull":
        for r in commands.pull(mine, arguments[0]).toLocalIterator():
            say(f"{r.id}: {r.claim}" + (f" ·· {r.label}" if r.label else "") + "\n" + "\n".join("  > " + x for x in r.body.strip().split("\n")))
    elif command == "status" and "--open" in options:
        waiting = commands.status_open(mine)
        say("\n".join(f"{lane}: {text}" for lane, text in waiting) or "nothing is waiting")
    elif command == "reindex" and "--check" in options:
        found = commands.reindex_diff(mine)
        say("\n".join("\n".join([f"{n}: {'DIFFERS' if lines else 'in sync'}", *lines]) for n, lines in found.items()))
        return int(any(found.values()))
    elif command == "quotes":
        spans = commands.quotations(mine).orderBy("unit", "line").collect()
        say("\n".join(f"{r.unit} line {r.line}: {r.state}{' ' + ', '.join(r.codes) if r.codes else ''}" for r in spans) or "no quotations")
        return int(any(r.state not in ("sealed", "binary-cold-debt", "unmarked") for r in spans))
    elif command == "conflict":
        word = arguments[0]
        if word == "list" and len(arguments) == 1:
            for i, targets, claims in commands.conflict_list(mine):
                say(f"{i} [{', '.join(targets)}] {' | '.join(claims)}")
        elif word == "add" and len(arguments) == 2:
            say(writers.conflict_add(mine, json.loads(arguments[1])))
        elif word == "remove" and len(arguments) == 2:
            writers.conflict_remove(mine, arguments[1])
        else:
            raise Refusal("conflict list, conflict add ENTRY or conflict remove ID")
    else:
        simple = {
            "census": lambda: commands.census(mine),
            "impact": lambda: commands.impact(mine, arguments[0]),
            "gaps": lambda: commands.gaps(mine, *arguments),
            "status": lambda: commands.status(mine),
            "lang": lambda: mine.project.fields.get("language", ""),
            "reindex": lambda: writers.reindex(mine),
            "retag": lambda: writers.retag(mine, *arguments, dry="--dry" in options),
            "attest": lambda: writers.attest(mine, *arguments[:3], arguments[3:]),
            "intake": lambda: writers.intake(mine, *arguments, no_source="--no-source" in options, anchor_existing="--anchor-existing" in options),
            "alloc": lambda: writers.alloc(mine, arguments[0]),
            "seal-review": lambda: writers.seal_review(mine, arguments[0]),
            "consecrate": lambda: writers.consecrate(mine, arguments[0]),
        }
        say(json.dumps(simple[command](), ensure_ascii=False))
    return 0


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    sys.exit(run(SparkSession.builder.getOrCreate(), sys.argv[1:]))

"""What the prompt answers."""

from __future__ import annotations

from tessel.plans.engine import Engine, Outcome
from tessel.sources.display import format_table

_HELP = "\\dt lists tables, \\q leaves, \\? shows this; statements end with ;"


def answer(engine: Engine, line: str) -> str | None:
    """What to print for a statement or a command; None to leave."""
    word = line.strip().lower()
    if word in ("\\q", "\\quit"):
        return None
    if word in ("\\?", "\\h", "\\help"):
        return _HELP
    if word == "\\dt":
        return "\n".join(engine.tables()) or "no tables"
    try:
        got = engine.execute(line)
        return got.message if isinstance(got, Outcome) else format_table(got)
    except Exception as e:  # noqa: BLE001  a prompt goes on
        return f"ERROR: {str(e).splitlines()[0]}"

"""A prompt: statements end with a semicolon; \\dt lists tables, \\? helps, \\q leaves.

python -m tessel.cli [FOLDER] [--config FILE]: tables are in FOLDER, or where the file's data_directory says, or in
tessel-data. The file, tessel.conf if there is one, may also hold settings of Spark; buffer_pool_size and its like are Spark's to choose.
"""

from __future__ import annotations

import argparse
import os

from tessel.plans import Engine
from tessel.plans.prompt import answer
from tessel.session import session
from tessel.sources import read_config, spark_settings

CONFIG, FOLDER = "tessel.conf", "tessel-data"


def started(args: list[str] | None = None) -> Engine:
    """The engine that the arguments and the configuration file ask for."""
    parser = argparse.ArgumentParser(prog="tessel")
    parser.add_argument("folder", nargs="?")
    parser.add_argument("--config")
    given = parser.parse_args(args)
    config = read_config(given.config or CONFIG) if given.config or os.path.exists(CONFIG) else {}
    return Engine(session(settings=spark_settings(config)), given.folder or config.get("data_directory", FOLDER))


def main() -> None:
    engine, text = started(), ""
    while True:
        try:
            text += input("tessel> " if not text else "   ...> ") + "\n"
        except EOFError:
            return
        if text.strip().startswith("\\") or text.rstrip().endswith(";"):
            if (said := answer(engine, text)) is None:
                return
            print(said)
            text = ""


if __name__ == "__main__":
    main()

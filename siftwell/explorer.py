"""Looking into manifests: ``python -m siftwell.explorer [manifest]``."""

from __future__ import annotations

import cmd
import sys

from .operators import records
from .session import session
from .sources import manifest as store


class Explorer(cmd.Cmd):
    """Commands: load PATH, info, list [N], find HASH-OR-TEXT, exit."""

    intro = "load PATH, info, list [N], find TEXT, exit"
    prompt = "manifest> "

    def __init__(self, spark=None, **streams) -> None:
        super().__init__(**streams)
        self.spark, self.files = spark or session(), None

    def say(self, text: str) -> None:
        self.stdout.write(text + "\n")

    def emptyline(self) -> bool:
        return False

    def _loaded(self) -> bool:
        if self.files is None:
            self.say("No manifest is loaded.")
        return self.files is not None

    def do_load(self, path: str) -> None:
        try:
            self.files = store.load(self.spark, path.strip()).files
            self.say(f"Loaded {path.strip()}")
        except ValueError as e:
            self.say(f"Error: {e}")

    def do_info(self, _: str) -> None:
        if self._loaded():
            r = records.info(self.files).first()
            self.say(f"Hashes: {r.hashes}\nFiles: {r.files}\nBytes: {r.bytes}")

    def do_list(self, limit: str) -> None:
        if not self._loaded():
            return
        try:
            k = int(limit) if limit.strip() else 10
        except ValueError:
            self.say("list takes a number")
            return
        last = None
        for r in records.listed(self.files, k).toLocalIterator():
            if r.hash != last:
                self.say(f"Hash: {r.hash}")
                last = r.hash
            self.say(f"  {r.path} ({r.size} bytes)")

    def do_find(self, query: str) -> None:
        if not self._loaded():
            return
        if not query.strip():
            self.say("find takes a hash or a part of a path")
            return
        n = 0
        for n, r in enumerate(records.find(self.files, query.strip()).orderBy("hash", "path").toLocalIterator(), 1):
            self.say(f"{r.hash}  {r.path}")
        if not n:
            self.say(f"Nothing found for {query.strip()!r}")

    def do_exit(self, _: str) -> bool:
        return True

    do_EOF = do_quit = do_exit


def main(argv: list[str] | None = None) -> None:
    argv = sys.argv[1:] if argv is None else argv
    shell = Explorer()
    if argv:
        shell.onecmd(f"load {argv[0]}")
    shell.cmdloop()


if __name__ == "__main__":
    main()

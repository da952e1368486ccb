"""A line shell over a store: put, get, del, flush, compact, stats, quit."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession

from sedimo.schema import Options
from sedimo.sources.store import Store

#: Small, so that flushes and compactions can be watched.
MEMTABLE_BYTES = 4096
DEFAULT_PATH = "./sedimo_data"


def run(store: Store, lines: Iterable[str]) -> Iterator[str]:
    """The answer to each line.

    The key is the second word; the value is the rest of the line without
    leading white space.  A missing word is empty, a blank line has no answer,
    and the end of input ends the shell.
    """
    for line in lines:
        command, _, *_ = parts = [*line.rstrip("\n").split(None, 2), "", "", ""]
        key, value = parts[1], parts[2]
        match command:
            case "put":
                store.put(key, value)
                yield "ok"
            case "get":
                found = store.get(key)
                yield "(not found)" if found is None else found.decode(errors="replace")
            case "del":
                store.delete(key)
                yield "ok"
            case "flush":
                store.flush()
                yield "flushed"
            case "compact":
                store.compact()
                yield "compacted"
            case "stats":
                s = store.stats()
                yield (
                    f"sstables={s.sstables} entries={s.sstable_entries} flushes={s.flushes} compactions={s.compactions} "
                    f"bloom_skips={s.bloom_skips} table_probes={s.table_probes}"
                )
            case "quit" | "exit":
                return
            case "":
                continue
            case _:
                yield "unknown command"


def main() -> None:
    path = sys.argv[1] if len(sys.argv) > 1 else DEFAULT_PATH
    spark = SparkSession.builder.appName("sedimo shell").getOrCreate()
    store = Store.open(spark, path, Options(memtable_bytes=MEMTABLE_BYTES))
    print(f"opened {path}  (commands: put get del flush compact stats quit)")
    for answer in run(store, sys.stdin):
        print(answer, flush=True)


if __name__ == "__main__":
    main()

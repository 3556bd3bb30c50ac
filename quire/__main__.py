"""python -m quire FOLDER VERB ...: rebuild, index, match, info, matches, ngram, query, get."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from quire.library import Library
from quire.sources import corpora


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="quire", description=__doc__)
    p.add_argument("folder")
    p.add_argument("verb", choices=["rebuild", "index", "match", "info", "matches", "ngram", "query", "get"])
    p.add_argument("what", nargs="*")
    p.add_argument("--manifest", action="append", default=[])
    p.add_argument("--fuzzy", action="store_true")
    p.add_argument("--dedup", choices=["rank", "oldest"])
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("quire").getOrCreate()
    library, known = Library(spark, a.folder), corpora.registered(*a.manifest)
    chosen = [known[n] for n in a.what] if a.what and a.verb in ("rebuild", "index") else list(known.values())
    if a.verb == "rebuild":
        print(library.rebuild(chosen))
    elif a.verb == "index":
        library.index(chosen)
    elif a.verb == "match":
        library.match(tuple(a.what), a.fuzzy)
    elif a.verb == "info":
        library.info().show(200, False)
    elif a.verb == "matches":
        library.matches(" ".join(a.what)).show(200, False)
    elif a.verb == "ngram":
        library.ngram(a.what, dedup=a.dedup).orderBy("word", "period").show(1000, False)
    elif a.verb == "query":
        library.query(" ".join(a.what)).show(200, False)
    else:
        print(library.get(a.what[0]))


if __name__ == "__main__":
    main()

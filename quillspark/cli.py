"""Command line: ``python -m quillspark.cli build|query|verify|check``."""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import index, prune, search, traversal, verify
from .plans.staging import cut
from .sources import collection

AUDIT_TERMS = ("the", "of", "and", "for", "with", "this")


def stride(text: str) -> int:
    value = int(text)
    if not 0 < value < 1 << 32:
        raise argparse.ArgumentTypeError("a positive number is expected")
    return value


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillspark")
    sub = top.add_subparsers(dest="command", required=True)
    build = sub.add_parser("build", help="index a collection of lines: id TAB text")
    build.add_argument("collection")
    build.add_argument("index")
    query = sub.add_parser("query", help="answer a file of queries, or ask for them")
    query.add_argument("index")
    query.add_argument("--collection", help="needed for snippets")
    query.add_argument("--batch")
    query.add_argument("--mode", choices=("0", "1"))
    query.add_argument("--out")
    query.add_argument("--snippets", action="store_true")
    query.add_argument("--walk", action="store_true", help="also count what a walk over documents would touch (OR only)")
    query.add_argument("--time-each", action="store_true", help="also time each query of a batch on its own")
    fresh = sub.add_parser("check", help="check an index against its collection")
    fresh.add_argument("index")
    fresh.add_argument("collection")
    fresh.add_argument("terms", nargs="*")
    audit = sub.add_parser("verify", help="check score bounds")
    audit.add_argument("index")
    audit.add_argument("stride", nargs="?", type=stride, default=89)
    return top


def check(tables: dict, docs, terms: Sequence[str]) -> int:
    """Compares an index with the collection: passages, lengths, and greatest scores of some terms, counted anew."""
    if wrong := verify.collection_mismatch(tables["passages"], tables["stats"], docs):
        print(f"max_score check failed: {wrong}")
        return 1
    rows = verify.max_score_audit(tables["lexicon"], docs, terms).orderBy("term").collect()
    for r in rows:
        print("ok " if r["ok"] else "BAD", r["term"], r["doc_count"], r["max_score"])
    for t in sorted(set(terms) - {r["term"] for r in rows}):
        print("ok ", t, "is in neither")
    good = all(r["ok"] for r in rows)
    print("max_score check", "passed" if good else "failed")
    return int(not good)


def interactive(spark: SparkSession, tables: dict, docs) -> None:
    while True:
        try:
            text = input("query> ")
            if text in ("exit", "quit"):
                return
            if not text:
                continue
            mode = search.AND if input("mode (0 AND, 1 OR)> ").strip() == "0" else search.OR
        except EOFError:
            return
        asked = spark.createDataFrame([(0, text)], "query_idx int, query string")
        began = time.perf_counter()
        found = search.search_index(tables["postings"], tables["passages"], tables["stats"], asked, mode)
        found = search.with_snippets(found, docs, asked) if docs is not None else found
        rows = found.orderBy("rank").collect()
        for r in rows:
            print(f"{r['rank']}. [{r['pid']}] {r['score']:.4f}", r["snippet"] if docs is not None else "")
        print(f"{len(rows)} result(s) in {(time.perf_counter() - began) * 1000:.1f} ms")


def batch_summary(tables: dict, asked, mode: int, took: list[float], walk: bool) -> None:
    """Prints latencies, if each query was timed, and for disjunctive queries what the score bounds spare."""
    spark = asked.sparkSession
    if took:
        s = verify.latency_stats(spark.createDataFrame([(x,) for x in took], "ms double")).first()
        print(f"latency (ms): n={s['n']} p50={s['p50']:.3f} p95={s['p95']:.3f} mean={s['mean']:.3f} min={s['least']:.3f} max={s['most']:.3f}")
    if mode == search.OR:
        terms = cut(search.query_terms(asked))
        theta = cut(prune.thresholds(terms, tables["chunks"]))
        bounds = prune.list_bounds(search.query_tokens(asked), tables["lexicon"])
        verdicts = prune.chunk_verdicts(terms, tables["chunks"], tables["lexicon"], theta)
        s = prune.pruning_summary(prune.query_stats(verdicts, terms, tables["lexicon"], prune.essential_lists(bounds, theta), asked)).first()
        print(f"pruning: {s['postings_kept'] or 0} of {s['total_postings'] or 0} postings needed, {s['pruned_percent']:.3f} % spared, mean essential lists {s['mean_essential'] or 0:.3f}, chunks dropped {s['chunks_dropped'] or 0}")
        if walk:
            counted = traversal.traversal_stats(asked, tables["chunks"], tables["lexicon"])
            scored, total, essential, skipped = counted.agg(F.sum("postings_scored"), F.sum("total_postings"), F.avg("essential_after_warmup"), F.sum("chunks_skipped")).first()
            share = 100 * (1 - (scored or 0) / total) if total else 0.0
            print(f"walk: {scored or 0} of {total or 0} postings scored, {share:.3f} % pruned, mean essential lists after warm-up {essential or 0:.3f}, chunks skipped {skipped or 0}")


def batch(spark: SparkSession, tables: dict, docs, args) -> int:
    asked = collection.read_queries(spark, args.batch)
    ask = lambda queries: search.search_index(tables["postings"], tables["passages"], tables["stats"], queries, int(args.mode))
    took = []
    if args.time_each:  # one query after another, as the batch itself is answered all at once
        for r in asked.orderBy("query_idx").collect():
            one = spark.createDataFrame([(r["query_idx"], r["query"])], "query_idx int, query string")
            began = time.perf_counter()
            ask(one).collect()
            took.append((time.perf_counter() - began) * 1000)
    began, n = time.perf_counter(), asked.count()
    found = ask(asked)
    collection.write_results(search.with_snippets(found, docs, asked) if args.snippets else found, args.out)
    spent = time.perf_counter() - began
    print(f"{n} queries, mode {args.mode} ({'OR' if int(args.mode) == search.OR else 'AND'}), in {spent:.3f} s; mean {1000 * spent / max(n, 1):.3f} ms")
    batch_summary(tables, asked, int(args.mode), took, args.walk)
    return 0


def main(arguments: list[str] | None = None) -> int:
    top = parser()
    try:
        args = top.parse_args(arguments)
    except SystemExit as e:
        return 1 if e.code else 0
    if args.command == "query" and (args.batch is None) != (args.mode is None):
        print("--batch and --mode go together", file=sys.stderr)
        return 1
    if args.command == "query" and args.batch and not args.out or getattr(args, "snippets", False) and not args.collection:
        print("--batch needs --out, and --snippets needs --collection", file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("quillspark").getOrCreate()
    if args.command == "build":
        began = time.time()
        collection.save_index(collection.scan_collection(spark, args.collection), args.index)
        print(f"indexed in {time.time() - began:.1f} s")
        return 0
    tables = collection.load_index(spark, args.index)
    if args.command == "verify":
        scored = index.contributions(tables["postings"], tables["stats"])
        terms = verify.audited_terms(tables["lexicon"], AUDIT_TERMS, args.stride)
        report = verify.bound_audit(tables["chunks"], scored, terms).first()
        print(report.asDict())
        return int(report["violations"] > 0)
    docs = collection.scan_collection(spark, args.collection) if args.collection else None
    if args.command == "check":
        return check(tables, docs, args.terms or AUDIT_TERMS)
    if args.batch is None:
        interactive(spark, tables, docs)
        return 0
    return batch(spark, tables, docs, args)


if __name__ == "__main__":
    sys.exit(main())

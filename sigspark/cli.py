"""The engine from the command line: python -m sigspark TOOL ..."""

from __future__ import annotations

import argparse
import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.functions import sizing
from sigspark.functions.terms import canonical_windows
from sigspark.model import TYPE_NAMES, ClassicParams, CompactParams
from sigspark.operators import build, listing, workload
from sigspark.plans import index
from sigspark.plans.documents import DocumentList
from sigspark.sources.files import read_files, write_queries


def _session() -> SparkSession:
    return SparkSession.builder.appName("sigspark").getOrCreate()


def _lines(df: DataFrame) -> Iterable[str]:
    return (r[0] for r in df.toLocalIterator())


def doc_list(a: argparse.Namespace) -> None:
    found = DocumentList(_session(), a.path, a.file_type, a.term_size)
    for d in found:
        print(d.doc_id, d.size, d.num_terms, d.path, d.name, sep="\t")
    print(json.dumps(listing.summary(found.documents).first().asDict()))


def doc_dump(a: argparse.Namespace) -> None:
    terms = listing.dump(read_files(_session(), a.path, a.file_type), a.term_size, a.canonicalize)
    for line in _lines(terms.orderBy("path", "subdoc_index").select(F.concat_ws("\t", "name", F.decode("term", "ISO-8859-1")))):
        print(line)


def _params(kind: type, a: argparse.Namespace):
    return kind(**{k: getattr(a, k) for k in kind.__dataclass_fields__ if getattr(a, k, None) is not None})


def classic_construct(a: argparse.Namespace) -> None:
    index.construct_classic(_session(), a.path, a.out, _params(ClassicParams, a), a.file_type, a.mode)


def compact_construct(a: argparse.Namespace) -> None:
    index.construct_compact(_session(), a.path, a.out, _params(CompactParams, a), a.file_type, a.mode)


def classic_construct_random(a: argparse.Namespace) -> None:
    index.write(workload.random_index(_session(), a.num_documents, a.document_size, a.signature_size, _params(ClassicParams, a), a.seed), a.out, a.mode)


def compact_construct_combine(a: argparse.Namespace) -> None:
    index.combine_compact(_session(), a.paths, a.out, a.page_size, a.mode)


def query(a: argparse.Namespace) -> None:
    found = index.Index.load(_session(), *a.index)
    if (a.query is None) == (a.file is None):
        raise SystemExit("a query or a query file is needed")
    lines = index.search_file(found, a.file, a.threshold, a.limit) if a.file else index.result_lines(found.search(a.query, a.threshold, a.limit))
    for line in _lines(lines):
        print(line)


def print_parameters(a: argparse.Namespace) -> None:
    print(json.dumps(sizing.parameters(a.num_elements, a.num_hashes, a.false_positive_rate)))


def print_kmers(a: argparse.Namespace) -> None:
    seq = _session().createDataFrame([(bytearray(a.query.encode()),)], "seq binary")
    for line in _lines(canonical_windows(seq, a.term_size).orderBy("pos").select(F.decode("term", "ISO-8859-1"))):
        print(line)


def benchmark_fpr(a: argparse.Namespace) -> None:
    times, histogram = workload.benchmark(index.read(_session(), a.index), a.queries, a.num_kmers, a.warmup, a.seed)
    print(json.dumps({k: round(v, 3) for k, v in times.items()}))
    if a.fpr_dist:
        for r in histogram.orderBy("score").toLocalIterator():
            print(r.score, r.pairs, sep="\t")


def generate_queries(a: argparse.Namespace) -> None:
    made = workload.generate_queries(read_files(_session(), a.path, a.file_type), a.positive, a.negative, a.term_size, a.size, a.true_negatives, a.seed)
    write_queries(made.coalesce(1), a.out)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sigspark", description=__doc__)
    tools = top.add_subparsers(dest="tool", required=True)

    def tool(f, *places: str, **more: tuple) -> argparse.ArgumentParser:
        p = tools.add_parser(f.__name__.replace("_", "-"))
        p.set_defaults(run=f)
        for name in places:
            p.add_argument(name.rstrip("+"), **({"nargs": "+"} if name.endswith("+") else {}))
        for name, (kind, default) in more.items():
            p.add_argument("--" + name.replace("_", "-"), **({"action": "store_true"} if kind is bool and not default else {"action": argparse.BooleanOptionalAction, "default": True} if kind is bool else {"type": kind, "default": default}))
        return p

    term, kinds = {"term_size": (int, 31)}, sorted(TYPE_NAMES)
    hashes = {"num_hashes": (int, 1), "false_positive_rate": (float, 0.3)}
    build_ = term | hashes | {"canonicalize": (bool, True), "family": (str, "xxh64"), "mode": (str, "errorifexists")}
    typed = [tool(doc_list, "path", **term), tool(doc_dump, "path", canonicalize=(bool, True), **term)]
    typed += [tool(classic_construct, "path", "out", signature_size=(int, 0), **build_), tool(compact_construct, "path", "out", page_size=(int, 0), **build_)]
    tool(classic_construct_random, "out", num_documents=(int, 10000), document_size=(int, 1000000), signature_size=(int, 2 << 20), seed=(int, 0), mode=(str, "errorifexists"), **term, **hashes)
    tool(compact_construct_combine, "paths+", "out", page_size=(int, 8192), mode=(str, "errorifexists"))
    tool(query, "index+", query=(str, None), file=(str, None), threshold=(float, 0.8), limit=(int, 0))
    tool(print_parameters, num_elements=(int, 0), **hashes)
    tool(print_kmers, "query", **term)
    tool(benchmark_fpr, "index", queries=(int, 10000), num_kmers=(int, 1000), warmup=(int, 100), seed=(int, 0), fpr_dist=(bool, False))
    typed.append(tool(generate_queries, "path", "out", positive=(int, 0), negative=(int, 0), true_negatives=(bool, False), size=(int, 0), seed=(int, 0), **term))
    for p in typed:
        p.add_argument("--file-type", default="any", choices=kinds)
    return top


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(a)

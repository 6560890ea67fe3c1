"""Answer a question spec over files: the package's command-line entry.

    python -m quarry.cli --source sales=/data/sample-sale.csv --spec spec.json

``--source name=path`` may repeat; the reader follows the extension
(.csv .tsv .json .jsonl .parquet .txt .md .log .html .htm .xml). The spec is
a JSON list of items (see ``quarry.plans.spec``); the answer JSON is printed.
"""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import DataFrame, SparkSession

from quarry.plans.spec import answer
from quarry.session import get_session
from quarry.sources import files as S


def read_any(spark: SparkSession, path: str, row_tag: str = "row") -> DataFrame:
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext == ".csv":
        return S.read_csv(spark, path, encoding=None, infer=True)
    if ext == ".tsv":
        return S.read_csv(spark, path, sep="\t", encoding=None, infer=True)
    if ext == ".json":
        return S.read_json_documents(spark, path)
    if ext == ".jsonl":
        return S.read_jsonl(spark, path)
    if ext == ".parquet":
        return S.read_parquet(spark, path)
    if ext in (".html", ".htm"):
        return S.read_text_documents(spark, path)
    if ext == ".xml":
        return S.read_xml(spark, path, row_tag)
    return S.read_text_lines(spark, path)


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    ap.add_argument("--source", action="append", default=[], help="name=path")
    ap.add_argument("--spec", required=True, help="JSON file with the spec items")
    ap.add_argument("--master", default=None)
    args = ap.parse_args(argv)
    spark = get_session(args.master)
    sources = {}
    for s in args.source:
        name, path = s.split("=", 1)
        sources[name] = read_any(spark, path)
    with open(args.spec) as fh:
        spec = json.load(fh)
    print(answer(spark, sources, spec).first()["answer_json"])


if __name__ == "__main__":
    main()

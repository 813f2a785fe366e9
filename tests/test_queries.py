"""Every query with SQL beside it, on the smallest tables, against DuckDB."""

import glob
import json
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from turnmill.functions import structural

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    found = duckdb.connect()
    for path in glob.glob(f"{DIR}/*.parquet"):
        found.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return found


def _plain(rows):
    return sorted(repr(tuple(None if v != v else round(v, 4) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(k for k in entry.oracle_sql() if not k.startswith("op") and k != "pipeline"))
def test_query(spark, con, name):
    mine = entry.queries()[name](spark, DIR)
    theirs = con.sql(entry.oracle_sql()[name])
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert _plain(mine.select(*theirs.columns).collect()) == _plain(theirs.fetchall())


def _spans(text):
    """JSON values of a text, from the decoder at every bracket."""
    found, at, decoder = [], 0, json.JSONDecoder()
    while at < len(text):
        try:
            value, end = decoder.raw_decode(text, at) if text[at] in "{[" else (None, at)
        except ValueError:
            end = at
        if end > at:
            found.append((at, end, value))
        at = max(end, at + 1)
    return found


def _cleaned(text):
    out, at = [], 0
    for a, b, value in _spans(text):
        out += [text[at:a], json.dumps(structural.shortened(value), separators=(",", ":"), ensure_ascii=False)]
        at = b
    made = re.sub(r"\.{4,}", "...", re.sub(r"\?{2,}", "?", re.sub("!{2,}", "!", "".join(out) + text[at:])))
    made = re.sub(r"[ \t]+", " ", re.sub(r"\n{3,}", "\n\n", made))
    return "\n".join(line.rstrip() for line in made.split("\n")).strip()


def test_json_queries_row_by_row(spark, tmp_path):
    """json_spans and json_compress over pages, and over pages that hold JSON of all kinds."""
    pages = [(r["page_id"], r["html"]) for r in spark.read.parquet(f"{DIR}/pages.parquet").collect()]
    blobs = ['{"message": {"content": [1, 2.50, "a  b!!"]}}', "[[1], [2", '{"a": "}"}', '{"k": NaN, "configuration": null}', "[]", "{x}", '["\\u00e9", "\\""]', '{"parameters": 1, "parameter": 2, "param": 3}', "{'a': 1}", "[1,]"]
    pages += [(10_000 + k, f"<p>{a}</p>\n\n\n\n<script>var x = {b} ;</script>....  {a}{b}") for k, (a, b) in enumerate((a, b) for a in blobs for b in blobs)] + [(20_000, None), (20_001, "")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    spans = {r["page_id"]: (r["n_spans"], [tuple(x) for x in r["spans"]]) for r in entry.queries()["json_spans"](spark, str(tmp_path)).collect()}
    assert spans == {k: (len(f := _spans(t or "")), [(a, b) for a, b, _ in f]) for k, t in pages} and sum(n for n, _ in spans.values()) > 200
    sizes = {r["page_id"]: (r["n_chars"], r["n_clean"]) for r in entry.queries()["json_compress"](spark, str(tmp_path)).collect()}
    assert sizes == {k: (None if t is None else len(t), len(_cleaned(t or ""))) for k, t in pages}


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "session_id"


def _plan(spark, name):
    return entry.queries()[name](spark, DIR)._jdf.queryExecution().optimizedPlan().toString().split("\n")


def _below(lines, k):
    """The lines of a plan under a line."""
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    end = next((j for j in range(k + 1, len(lines)) if depth(lines[j]) <= depth(lines[k])), len(lines))
    return lines[k + 1 : end]


def test_word_sets_are_made_once(spark):
    """removed_entities: a turn's words and its query's are found once each, not for every use in the score."""
    assert sum(line.count("[a-z0-9']+") for line in _plan(spark, "removed_entities")) == 2


def test_names_are_found_before_joins(spark):
    """load_bearing_turns: a query's names aren't found again beside each turn, nor a turn's above the join of its text."""
    lines = _plan(spark, "load_bearing_turns")
    found = [k for k, line in enumerate(lines) if "https?://" in line]
    assert found and not any("Join" in line for k in found for line in _below(lines, k))


def test_names_are_found_once_for_both_windows(spark):
    """entity_recall: the recent turns' names are those found for all turns, and below the window."""
    lines = _plan(spark, "entity_recall")
    found = [k for k, line in enumerate(lines) if "https?://" in line]
    assert len(found) == 1 and not any("Window" in line for line in _below(lines, found[0]))

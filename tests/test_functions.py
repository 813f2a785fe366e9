"""Text, token, JSON, similarity and entity columns against expected values."""

import json
import math
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnmill.functions import entities, similarity, sqlfuncs, structural, text, tokens
from turnmill.operators.graph import name_parts


def one(spark, column, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ('{\n  "configuration": {\n    "environment": "prod"\n  }\n}', '{"cfg":{"env":"prod"}}'),
        ('[{"message": "hi"}, {"message": "bye"}]', '[{"msg":"hi"},{"msg":"bye"}]'),
        ("Wait!!! Really??? Hmm....", "Wait! Really? Hmm..."),
        ("line 1\n\n\n\nline 2    with    spaces", "line 1\n\nline 2 with spaces"),
        ("Use the set {1, 2, 3} and the template {name}", "Use the set {1, 2, 3} and the template {name}"),
        ('see {"message":1}{"message":2}', 'see {"msg":1}{"msg":2}'),
        ("", ""),
        (None, ""),
    ],
)
def test_structural(spark, given, expected):
    assert one(spark, structural.compress(F.col("x")), given) == expected


def test_json_spans():
    outer = 'before {"a": {"b": [1, 2, {"c": 3}]}} after'
    assert [(a, b) for a, b, _ in structural.json_spans(outer)] == [(7, len(outer) - 6)]
    curly = 'prefix {"text": "value with {curly} braces"} suffix'
    assert [curly[a:b] for a, b, _ in structural.json_spans(curly)] == ['{"text": "value with {curly} braces"}']
    assert structural.json_spans("{" * 3000 + "x") == []
    assert [v for _, _, v in structural.json_spans('{bad [1, 2] {"k": "a\\"b"}')] == [[1, 2], {"k": 'a"b'}]


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=6), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.sampled_from(["message", "content", "k"]), c, max_size=3), max_leaves=8))
def test_json_rewrite_keeps_values(value):
    if isinstance(value, (dict, list)):
        spoken = "say " + json.dumps(value) + " now"
        assert structural.rewritten(spoken) == "say " + json.dumps(structural.shortened(value), separators=(",", ":"), ensure_ascii=False) + " now"
        assert structural.rewritten(structural.rewritten(spoken)) == structural.rewritten(spoken)


def test_normalize(spark):
    assert one(spark, text.normalize_prompt(F.col("x")), "  a\r\na\n\n\n\nb  \t c\nb c ") == "a\n\nb c"
    assert one(spark, text.normalize_prompt(F.col("x")), None) == ""


def test_tokens(spark):
    assert one(spark, tokens.claude_estimate(F.col("x")), "a" * 7) == 2
    assert one(spark, tokens.claude_estimate(F.col("x")), "") == 0
    assert one(spark, tokens.words(F.col("x")), " a  b c ") == 3
    assert one(spark, tokens.count(F.col("x"), "Claude-3"), "hello") == math.floor(5 / 3.5 + 0.5)
    assert one(spark, tokens.percent(F.lit(500), F.lit(350))) == 30.0
    assert one(spark, tokens.input_price(F.col("x")), "gpt-4o-mini") == 5.0
    assert one(spark, tokens.detect(F.col("x")), "claude-3-5-sonnet")["ctx_window"] == 200_000


def test_similarity(spark):
    arrays = lambda a, b: (F.array(*map(F.lit, a)) if a else F.array().cast("array<string>"), F.array(*map(F.lit, b)) if b else F.array().cast("array<string>"))
    assert one(spark, similarity.ochiai(*arrays("ab", "bcd"))) == pytest.approx(1 / math.sqrt(6))
    assert one(spark, similarity.ochiai(*arrays("", "b"))) == 0
    assert one(spark, similarity.jaccard_distance(*arrays("ab", "bc"))) == pytest.approx(2 / 3)
    assert one(spark, similarity.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))) == 0


@pytest.mark.parametrize(
    ("raw", "canonical"),
    [("file.py", "file.py"), ("auth.py", "auth"), ("AuthService", "auth"), ("config.yaml", "config"), ("validate_token(", "vali_token"), ("task #42", "task_42"), ("issue #7", "issue"), ("OPENAI_API_KEY", "openai_api_key")],
)
def test_canonical_names(spark, raw, canonical):
    assert one(spark, entities.canonical(F.col("x")), raw) == canonical
    assert ("_".join(name_parts(raw)) or raw.lower()) == canonical


def test_entities(spark):
    found = one(spark, entities.extract(F.col("x")), "I'm working on file.py for task #42, see https://a.io/x and AuthService.login() in the billing module")
    assert found["file"][0] == "file.py" and found["task"] == ["task_42"] and found["url"] == ["https://a.io/x"] and found["class"] == ["auth"] and "login" in found["function"]
    rows = sqlfuncs.found_entities("see task #42 in config.yaml")
    assert ("task", "task_42", 0) in rows and ("file", "config", 0) in rows


def test_context_loss(spark):
    assert one(spark, text.context_loss(F.col("x")), "well, As I mentioned before")["confidence"] == 0.95
    assert not one(spark, text.context_loss(F.col("x")), None)["detected"]


def test_sql_functions(spark):
    sqlfuncs.register(spark)
    row = spark.sql("""SELECT ctx_token_count('a b') AS n, ctx_keyword_sim('a b', 'b c') AS s, ctx_normalize('x\\n\\n\\n\\nx  y') AS t, ctx_compress('{"message": 1}!!!') AS c""").first()
    assert (row.n, row.s, row.t, row.c) == (2, 0.5, "x\n\nx y", '{"msg":1}!')
    assert spark.sql("SELECT * FROM ctx_extract_entities('task #42')").collect()[0]["name"] == "task_42"
    texts = spark.createDataFrame([(t,) for t in ENTITY_TEXTS], "x string")
    rows = texts.select("x", F.expr("ctx_entities(x)").alias("by_sql"), entities.extract(F.col("x")).alias("by_column")).collect()
    assert all(r.by_sql == r.by_column for r in rows) and any(r.by_sql for r in rows)


def _plain_spans(text):
    """JSON objects and arrays from left to right, by the standard decoder at every opening bracket."""
    out, at, decoder = [], 0, json.JSONDecoder()
    while at < len(text):
        if text[at] in "{[":
            try:
                value, end = decoder.raw_decode(text, at)
                out.append((at, end, value))
                at = end
                continue
            except ValueError:
                pass
        at += 1
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(['{"message": 1}', '[1, {"content": "a b"}]', "{", "}", "[", "]", '"', " and ", '{"k": [}', '{"a": {"b": [1, 2, {"c": 3}]}}', '"q" ', "\\"]), max_size=9))
def test_json_spans_against_the_decoder(parts):
    text = "".join(parts)
    assert [(a, b) for a, b, _ in structural.json_spans(text)] == [(a, b) for a, b, _ in _plain_spans(text)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["{", "}", "[", "]", '"', ",", ":", "1", "a", "\\", '"k":', "\n", " ", '\\"', "null", "-", "]}", '{"k":[', '["', "é"]), max_size=24))
def test_json_spans_of_any_brackets_and_quotes(parts):
    text = "".join(parts)
    assert structural.json_spans(text) == _plain_spans(text)


@pytest.mark.parametrize(
    "text",
    ["{" * 1_000_000, "[" * 1_000_000, '{"a":' * 200_000, '["' * 300_000, '{"a":[' * 100_000 + "x", "[" * 300_000 + "]" * 300_000, '{"k": "' + "{[" * 300_000, "{ " * 300_000, '[1, "[2, " ' * 100_000, "[" * 50_000 + "]" * 49_999 + "}", "[[1],x" * 150_000],
)
def test_json_spans_take_linear_time(text):
    begin = time.monotonic()
    found = structural.json_spans(text)
    assert time.monotonic() - begin < 30  # seconds on a busy machine; in quadratic time they take hours
    assert all(json.loads(text[a:b]) == v for a, b, v in found[:50])


def test_long_texts_are_normalised_in_linear_time(spark):
    lines = [f"line {k // 2}  x " for k in range(20_000)]
    begin = time.monotonic()
    made = one(spark, text.normalize_prompt(F.col("x")), "\n".join(lines))
    assert time.monotonic() - begin < 30 and made == "\n".join(f"line {k} x" for k in range(10_000))


ENTITY_TEXTS = [
    "I'm working on file.py for task #42, see https://a.io/x?q=1 and AuthService.login() in the billing core module",
    "user Ann said my name is Zoë; @bob Carl and I am Dave. data_loader.py, data_loader.py OPENAI_API_KEY HTTPServer parse_json(x)",
    "éfile.py cafe.pyé naïve_name ÜberClass StraßeName ISSUE 7 pr:12 story#3 U.S. v1.2.3", "", None, "nothing here",
]


def test_all_types_against_python(spark):
    """Every type of entity, name by name, against Python's regular expressions."""
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(ENTITY_TEXTS)], "k int, x string").select("k", entities.listed(F.col("x")).alias("l"), entities.all_names(F.col("x")).alias("a"), entities.extract(F.col("x")).alias("e")).collect()
    for k, found, names, by_type in rows:
        wanted = sqlfuncs.found_entities(ENTITY_TEXTS[k] or "")
        assert [(e["etype"], e["name"], e["pos"]) for e in found] == wanted, k
        assert names == list(dict.fromkeys(n for _, n, _ in wanted))
        assert by_type == {t: [n for u, n, _ in wanted if u == t] for t in dict.fromkeys(t for t, _, _ in wanted)}
    assert {t for row in rows for t in row["e"]} == set(entities.TYPES)


@pytest.mark.parametrize(("name", "no_file"), [("10.0.0.1", True), ("$3.50", True), ("U.S.", True), ("v1.2.3", True), ("main.py", False), (None, False)])
def test_false_files(spark, name, no_file):
    assert one(spark, entities.false_file(F.col("x")), name) is no_file


def test_bpe_counts(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path, texts = public.path("byte_bpe_50k.json"), ["hello world", "", None, "naïve  café\n\n" * 50, "x" * 5000]
    made = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, x string").select("k", tokens.count(F.col("x"), "gpt-4o", tokens.bpe_counter(path)).alias("n"), tokens.count(F.col("x"), "claude-3", tokens.bpe_counter(path)).alias("c")).collect()
    library = Tokenizer.from_file(path)
    assert {r.k: r.n for r in made} == {k: len(library.encode(t or "", add_special_tokens=False).ids) for k, t in enumerate(texts)}
    assert made[0].c == 3


def test_batches_in_parts(spark, monkeypatch):
    """Encoding and JSON work on a part of a batch at a time, whatever the batch holds."""
    import pyarrow as pa

    from turnmill.functions import text

    for texts, most in ((["ab", None, "", "cdé", "x" * 50, "y", "z"], 4), ([], 4), ([None, None], 1), (["abc"] * 9, 1 << 20)):
        found = list(text.ranges(pa.array(texts, pa.string()), most))
        assert [k for a, b in found for k in range(a, b)] == list(range(len(texts)))
        assert all(b - a == 1 or sum(len((t or "").encode()) for t in texts[a:b]) <= most for a, b in found)
    public = pytest.importorskip("public_tokenizers")
    import tokenizers

    sizes, encode = [], tokenizers.Tokenizer.from_file

    class Watched:
        def __init__(self, path):
            self.real = encode(path)

        def encode_batch(self, some, **options):
            sizes.append(sum(map(len, some)))
            return self.real.encode_batch(some, **options)

    monkeypatch.setattr(tokenizers, "Tokenizer", type("Files", (), {"from_file": staticmethod(Watched)}))
    many = [f"some words of text {k} " * 40 for k in range(3000)]
    counts = [n for part in tokens.bpe_counter(public.path("byte_bpe_50k.json")).func(iter([pa.array(many)])) for n in part.to_pylist()]
    assert max(sizes) <= tokens.ENCODED < sum(sizes) == sum(map(len, many)) and len(counts) == 3000

"""Structural compression: JSON within a text is minified and its keys shortened, then blanks and marks are cleaned.

Finding a JSON value in a text means matching brackets, which no built-in column expresses, so
the JSON step is an Arrow-batched function; texts without a bracket never reach it.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import cleanup_punctuation, cleanup_whitespace, filled, ranges

#: Short forms of JSON keys.  Fixed values.
SHORT_KEYS = {
    "authorization_token": "auth_tok", "authorization": "auth", "authentication": "authn", "configuration": "cfg", "environment": "env", "parameters": "params", "parameter": "param", "description": "desc", "response": "resp", "request": "req", "message": "msg", "messages": "msgs",
    "content": "cont", "function": "fn", "callback": "cb", "identifier": "id", "timestamp": "ts", "temperature": "temp", "information": "info", "initialize": "init", "initialization": "init", "additional": "addl", "properties": "props", "property": "prop", "conversation": "conv",
    "instructions": "instrs", "instruction": "instr", "requirements": "reqs", "requirement": "req", "implementation": "impl", "functionality": "func", "documentation": "docs", "notification": "notif", "notifications": "notifs", "subscription": "sub", "subscriptions": "subs",
    "organization": "org", "organizations": "orgs", "permissions": "perms", "permission": "perm", "validation": "valid", "validations": "valids", "transformation": "xform", "transformations": "xforms", "serialization": "serial", "deserialization": "deserial", "pagination": "paging",
    "deprecation": "depr", "deprecated": "depr", "synchronization": "sync", "asynchronous": "async", "synchronous": "sync", "compression": "compr", "decompression": "decompr", "encryption": "encr", "decryption": "decr", "certificate": "cert", "certificates": "certs",
    "credentials": "creds", "credential": "cred", "administrator": "admin", "administrators": "admins", "application": "app", "applications": "apps", "infrastructure": "infra", "microservice": "svc", "microservices": "svcs", "kubernetes": "k8s", "deployment": "deploy",
    "deployments": "deploys", "repository": "repo", "repositories": "repos", "dependency": "dep", "dependencies": "deps", "middleware": "mw", "transaction": "txn", "transactions": "txns", "connection": "conn", "connections": "conns", "exception": "exc", "exceptions": "excs",
    "stacktrace": "trace", "traceback": "trace", "debugging": "dbg", "profiling": "prof", "monitoring": "mon", "observability": "obs", "telemetry": "telem", "aggregation": "agg", "aggregations": "aggs", "calculation": "calc", "calculations": "calcs", "evaluation": "eval",
    "evaluations": "evals", "recommendation": "rec", "recommendations": "recs", "classification": "clf", "classifications": "clfs", "preprocessing": "preproc", "postprocessing": "postproc", "hyperparameter": "hparam", "hyperparameters": "hparams", "checkpoint": "ckpt",
    "checkpoints": "ckpts", "optimization": "optim", "optimizations": "optims", "regularization": "reg", "normalization": "norm", "tokenization": "tok", "tokenizer": "tok", "embedding": "emb", "embeddings": "embs", "transformer": "xfmr", "transformers": "xfmrs",
    "architecture": "arch", "architectures": "archs",
}

#: Where an object or array may begin: at a bracket before what can follow it in one.
_OPENER = re.compile(r'\{(?=[ \t\n\r]*["}])|\[(?=[ \t\n\r]*[\]\["{\-0-9tfnNI])')
#: Strings as a whole, brackets, and the quote of a string without an end.
_TOKEN = re.compile(r'"(?:[^"\\]++|\\.)*+"|[{}\[\]"]', re.S)
_DECODER = json.JSONDecoder()
#: Least part of a text that is cut anew for the decoder, whose errors count lines from the begin of what they are given.
_PART = 4096
#: Bytes of texts that stand as Python strings at a time (or one text).
HELD = 1 << 20


def _nested(text: str, start: int, end: int) -> list[tuple[int, int, bool]]:
    """(place, deepest nesting within, whether it is closed) of the brackets opened from start on, strings left out, up to the end or a string without one."""
    open_, found = [], []
    for mark in _TOKEN.finditer(text, start, end):
        kind = mark.group()
        if kind == '"':
            break
        if kind in "{[":
            open_.append([mark.start(), 1])
        elif kind in "}]" and open_:
            place, depth = open_.pop()
            found.append((place, depth, True))
            if open_:
                open_[-1][1] = max(open_[-1][1], depth + 1)
    below = 0
    for place, depth in reversed(open_):
        below = max(depth, below + 1)
        found.append((place, below, False))
    return found


@functools.cache
def _deepest() -> int:
    """How deeply nested an array the decoder takes."""
    low, high = 1, 1 << 20
    while low < high:
        middle = (low + high + 1) // 2
        try:
            _DECODER.raw_decode("[" * middle + "]" * middle)
            low = middle
        except RecursionError:
            high = middle - 1
    return low


def json_spans(text: str) -> list[tuple[int, int, object]]:
    """(start, end, value) of the JSON objects and arrays in a text, outermost first, from left to right.

    In linear time: where decoding from a bracket fails, all brackets open at that place fail there too and are not tried
    again.  A text has two ways of taking its quotes for begins or ends of strings, so no part is decoded more than
    twice without success.
    """
    found, at, failed = [], 0, set()
    part, base, step = text, 0, max(_PART, len(text) // 256)
    while (opener := _OPENER.search(text, at)) is not None:
        start = opener.start()
        at = start + 1
        if start in failed:
            continue
        if start - base > step:
            part, base = text[start:], start
        try:
            value, end = _DECODER.raw_decode(part, start - base)
        except json.JSONDecodeError as e:
            failed.update(place for place, _, closed in _nested(text, start, base + e.pos) if not closed)
        except RecursionError:
            failed.update(place for place, depth, _ in _nested(text, start, len(text)) if depth > _deepest())
        except ValueError:  # a number of more digits than Python takes
            continue
        else:
            found.append((start, base + end, value))
            at = base + end
    return found


def shortened(value: object) -> object:
    """The value with its keys' short forms; where two keys become one, the last stands."""
    if isinstance(value, dict):
        return {SHORT_KEYS.get(k, k): shortened(v) for k, v in value.items()}
    return [shortened(v) for v in value] if isinstance(value, list) else value


def rewritten(text: str) -> str:
    out, at = [], 0
    for start, end, value in json_spans(text):
        out += [text[at:start], json.dumps(shortened(value), separators=(",", ":"), ensure_ascii=False)]
        at = end
    return "".join(out) + text[at:]


def json_rewriter():
    """`rewritten` for a column, in Arrow batches of which only a part stands as Python strings at a time."""

    @F.arrow_udf("string")
    def rewrite(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [pa.array([t if t is None else rewritten(t) for t in texts[low:high].to_pylist()], pa.string()) for low, high in ranges(texts, HELD)]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return rewrite


def _span_finder():
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [pa.array([None if t is None else [{"start": a, "end": b} for a, b, _ in json_spans(t)] for t in texts[low:high].to_pylist()], kind) for low, high in ranges(texts, HELD)]
            yield pa.concat_arrays(parts) if parts else pa.array([], kind)

    return find


def _bracketed(text: Column) -> Column:
    return text.rlike(r"[{\[]")


def spans(text: Column) -> Column:
    """Where JSON values stand in a text."""
    t = filled(text)
    return F.when(_bracketed(t), _span_finder()(F.when(_bracketed(t), t).otherwise(""))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def rewrite_json(text: Column) -> Column:
    t = filled(text)
    return F.when(_bracketed(t), json_rewriter()(F.when(_bracketed(t), t).otherwise(""))).otherwise(t)


def compress(text: Column, may_hold_json: bool = True) -> Column:
    """JSON minified, marks and blanks cleaned."""
    return cleanup_whitespace(cleanup_punctuation(rewrite_json(text) if may_hold_json else filled(text)))

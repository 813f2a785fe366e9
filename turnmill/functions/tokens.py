"""Token counts, models and prices."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import filled, ranges

#: Tokens that frame a message list and each message.  Fixed values.
LIST_TOKENS, MESSAGE_TOKENS = 3, 4

#: family, encoding and context window by what a model's name contains.  Fixed values.
MODELS = {
    "gpt-4o": ("openai", "o200k_base", 128_000),
    "gpt-4": ("openai", "cl100k_base", 128_000),
    "gpt-3.5": ("openai", "cl100k_base", 16_385),
    "gpt-5": ("openai", "o200k_base", 200_000),
    "o1": ("openai", "o200k_base", 128_000),
    "o3": ("openai", "o200k_base", 200_000),
    "claude-3-5": ("anthropic", "anthropic", 200_000),
    "claude-3": ("anthropic", "anthropic", 200_000),
    "claude-2": ("anthropic", "anthropic", 100_000),
    "claude": ("anthropic", "anthropic", 200_000),
}
DEFAULT_MODEL = ("openai", "cl100k_base", 128_000)
#: USD for a million input tokens, in the order of the match.  Fixed values.
INPUT_PRICES = {"gpt-4o": 5.0, "gpt-4": 10.0, "gpt-3.5": 0.5, "gpt-5": 6.0, "o1": 15.0, "o3": 10.0, "claude-3-5-sonnet": 3.0, "claude-3-opus": 15.0, "claude-3-haiku": 0.25, "claude": 3.0}
#: USD for a thousand tokens in and out, as the chat endpoint has them.  Fixed values.
CHAT_PRICES = {"gpt-4o": (5.0, 15.0), "gpt-4": (30.0, 60.0), "gpt-3.5": (0.5, 1.5), "gpt-5": (6.0, 18.0), "claude": (3.0, 15.0)}
#: Models that a client may list.  Fixed values.
LISTED_MODELS = (
    ("gpt-4o", "openai"), ("gpt-4o-mini", "openai"), ("gpt-4-turbo", "openai"), ("gpt-4", "openai"), ("gpt-3.5-turbo", "openai"),
    ("claude-3-5-sonnet-20241022", "anthropic"), ("claude-3-5-haiku-20241022", "anthropic"), ("claude-3-opus-20240229", "anthropic"),
)

#: Bytes of text that are encoded at a time (or one text).
ENCODED = 1 << 18


def words(text: Column) -> Column:
    """Runs without white space."""
    return F.regexp_count(filled(text), F.lit(r"(?U)\S+")).cast("long")


def claude_estimate(text: Column) -> Column:
    """A token for 3.5 characters, rounded half up, one at least; an empty text has none."""
    n = F.length(filled(text))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 3.5 + 0.5))).cast("long")


def count(text: Column, model: Column | str = "gpt-4o", other: Callable[[Column], Column] = words) -> Column:
    """Tokens of a text: an estimate for models named claude..., else `other` (by default words)."""
    name = F.lit(model) if isinstance(model, str) else model
    return F.when(F.lower(name).startswith("claude"), claude_estimate(text)).otherwise(other(text))


def of_turn(role: Column, content: Column, model: Column | str = "gpt-4o", other: Callable[[Column], Column] = words) -> Column:
    """Tokens that a message adds to a list."""
    return count(content, model, other) + count(role, model, other) + MESSAGE_TOKENS


def bpe_counter(path: str) -> Callable[[Column], Column]:
    """A counter that encodes with a tokenizer file of the `tokenizers` library, loaded once a worker.

    Few texts are encoded at a time: an encoding holds much more than the ids that are counted.
    """

    @F.arrow_udf("long")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        for texts in batches:
            counts = []
            for low, high in ranges(texts, ENCODED):
                some = [t or "" for t in texts[low:high].to_pylist()]
                counts += [len(x.ids) for x in tokenizer.encode_batch(some, add_special_tokens=False)]
            yield pa.array(counts, pa.int64())

    return encoded


def _first(name: Column, table: dict, pick: Callable, default) -> Column:
    """The entry of the first key that the lower-cased name contains."""
    out = F.lit(default)
    for key in reversed(list(table)):
        out = F.when(F.lower(name).contains(key), F.lit(pick(table[key]))).otherwise(out)
    return out


def encoding(model: Column) -> Column:
    """Which public vocabulary a model counts with."""
    return _first(model, {k: v[1] for k, v in MODELS.items() if v[0] == "openai"}, lambda v: v, "cl100k_base")


def detect(model: Column) -> Column:
    """family, encoding and ctx_window of the longest key in the name."""
    table = {k: MODELS[k] for k in sorted(MODELS, key=len, reverse=True)}
    return F.struct(*[_first(model, table, lambda v, i=i: v[i], DEFAULT_MODEL[i]).alias(n) for i, n in enumerate(("family", "encoding", "ctx_window"))])


def input_price(model: Column) -> Column:
    """USD for a million input tokens."""
    return _first(model, INPUT_PRICES, float, 5.0)


def saved_cost(tokens: Column, model: Column) -> Column:
    return F.round(tokens / 1e6 * input_price(model), 6)


def chat_cost(model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    price = [_first(model, CHAT_PRICES, lambda v, i=i: v[i], CHAT_PRICES["gpt-4o"][i]) for i in (0, 1)]
    return tokens_in / 1000 * price[0] + tokens_out / 1000 * price[1]


def percent(before: Column, after: Column, digits: int = 2) -> Column:
    """What is saved, in percent of what was."""
    return F.round(100 * F.greatest(before - after, F.lit(0)) / F.greatest(before, F.lit(1)), digits)

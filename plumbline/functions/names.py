"""Column-name logic.  It runs on schema metadata, so it is bounded by the width of the table."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from plumbline.functions import fixed_values as fv


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def has_token(name: str, tokens: Iterable[str]) -> bool:
    low = name.lower()
    return any(token in low for token in tokens)


def is_id_like(name: str, tokens: Sequence[str] = fv.ID_TOKENS) -> bool:
    return has_token(name, tokens)


def item_prefix(name: str) -> str:
    """``q3`` -> ``q``: the name without its trailing number."""
    stripped = name.strip()
    head = re.sub(r"[_\-\s]*\d+$", "", stripped).strip("_- ")
    return head or stripped


def canonical(name: str) -> str:
    return re.sub(r"[\s\-.]+", "_", name).strip("_").lower()


def _marker_pattern(token: str) -> str:
    if token.startswith("_"):
        return rf"(?<![0-9]){re.escape(token)}(?![0-9])"
    if re.search("[a-z]", token):
        return rf"(?<![a-z0-9]){re.escape(token)}(?![a-z0-9])"
    return re.escape(token)


def name_side(
    name: str,
    pre: Sequence[str] = fv.PRE_TOKENS,
    post: Sequence[str] = fv.POST_TOKENS,
    measure_words: Sequence[str] = fv.MEASURE_WORDS,
) -> tuple[str, str | None]:
    """Base name and the side (``pre`` / ``post``) that the name marks."""
    text = canonical(name)
    words = "|".join(map(re.escape, measure_words)) or r"(?!)"
    for side, tokens in (("pre", pre), ("post", post)):
        for token in tokens:
            base, hits = re.subn(_marker_pattern(token), "", text, count=1)
            if hits:
                return re.sub(words, "", base).strip("_"), side
    return text, None


def pre_post_pairs(columns: Sequence[str], **tokens: Sequence[str]) -> list[tuple[str, str]]:
    """Pairs of columns that share a base name, one marked pre and one marked post."""
    sided = [(c, *name_side(c, **tokens)) for c in columns]
    posts: dict[str, str] = {}
    for column, base, side in sided:
        if side == "post":
            posts.setdefault(base, column)
    return [(c, posts[base]) for c, base, side in sided if side == "pre" and base in posts]


def prefix_groups(columns: Sequence[str]) -> dict[str, list[str]]:
    groups: dict[str, list[str]] = {}
    for column in columns:
        groups.setdefault(item_prefix(column), []).append(column)
    return groups

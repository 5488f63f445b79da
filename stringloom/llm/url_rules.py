"""URL filters: pattern rules indexed by their rarest literal token.

Every rule is a regular expression over the lower-cased URL together with the literal
tokens (runs of a-z and 0-9) that any URL it matches must hold. One aggregation counts how
many URLs hold each of the rules' tokens, and each rule is filed under its rarest one. A
URL fetches the rules filed under its own tokens and only those run their expression; rules
without a token are tried on all URLs. The rules are a list given by the caller, so the
index travels with the tasks; the URLs are neither shuffled nor exploded.

Among the rules that match, the highest priority wins, then the longer name, then allow.
Without any match the verdict is the default.

Defined cases: a null or empty URL matches nothing and gets the default; rows are judged
one by one, repeated or not; an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import lower_ascii

TOKEN = r"[a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """A named pattern over URLs with A-Z lower-cased in the host (or wholly, if folded).

    tokens: literal tokens that occur, as whole tokens, in every URL the pattern matches.
    """

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...] = field(default=())
    priority: int = 0


def host_rule(name: str, verdict: str, priority: int = 1) -> Rule:
    """A rule `host/path`: fits the host and its subdomains where the URL's path starts with the path."""
    host, slash, rest = name.partition("/")
    path = slash + rest
    pattern = r"^(?:(?!://).)*://(?:[^/?#]*\.)?" + re.escape(host) + r"(?=[/?#]|\Z)" + re.escape(path)
    inner = re.findall(TOKEN, path.lower())
    if inner and not re.search(r"[^A-Za-z0-9]$", path):
        inner.pop()  # its last token may go on in the URL
    return Rule(name, verdict, pattern, (*re.findall(TOKEN, host.lower()), *inner), priority)


def word_rule(word: str, verdict: str = "block") -> Rule:
    """A rule for a word anywhere in the URL, between characters that aren't a-z or 0-9, in any case."""
    return Rule(f"word:{word}", verdict, f"(?ai:(?<![a-z0-9]){re.escape(word)}(?![a-z0-9]))", (word,), 0)


def host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, with A-Z lower-cased; empty where there is none."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    """After the host up to ? or # or the end; empty where there is no host."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rarest_tokens(urls: DataFrame, rules: list[Rule], url: str = "url") -> dict[str, str]:
    """The token that each rule is filed under: that of the fewest URLs, by a count over all URLs."""
    wanted = sorted({t for r in rules for t in r.tokens})
    tokens = F.array_distinct(F.filter(F.split(lower_ascii(F.col(url)), "[^a-z0-9]+"), lambda t: t.isin(wanted)))
    counts = {r["t"]: r["n"] for r in urls.select(F.explode(tokens).alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}  # a row per rule token at most
    return {r.name: min(r.tokens, key=lambda t: (counts.get(t, 0), t)) for r in rules if r.tokens}


def judge(urls: DataFrame, rules: list[Rule], *, url: str = "url", default: str = "allow", rule: str = "rule", verdict: str = "verdict") -> DataFrame:
    """The rows with the name of the winning rule (null: none) and the verdict last."""
    filed = rarest_tokens(urls, rules, url)
    kept = [f for f in urls.schema.fields if f.name.lower() not in (rule.lower(), verdict.lower())]
    schema = T.StructType([*kept, T.StructField(rule, T.StringType()), T.StructField(verdict, T.StringType())])

    def run(batches):
        ranked = sorted(rules, key=lambda r: (-r.priority, -len(r.name), r.verdict != "allow", r.name))
        order = {r.name: (i, r.name, r.verdict, re.compile(r.pattern, re.S)) for i, r in enumerate(ranked)}
        index: dict[str, list] = {}
        for r in ranked:
            index.setdefault(filed.get(r.name, ""), []).append(order[r.name])
        split, anywhere = re.compile(TOKEN).findall, index.pop("", [])

        def winner(text):
            if not text:
                return None, default
            fetched = [c for t in set(split(text.translate(FOLD))) & index.keys() for c in index[t]]
            tried = sorted([*fetched, *anywhere], key=lambda c: c[0])
            head, sep, tail = text.partition("://")
            cut = re.search("[/?#]", tail)
            end = cut.start() if cut else len(tail)
            folded = head + sep + tail[:end].translate(FOLD) + tail[end:]
            return next(((name, v) for _, name, v, p in tried if p.search(folded)), (None, default))

        for batch in batches:
            found = [winner(x) for x in batch.column(url).to_pylist()]
            columns = [batch.column(f.name) for f in kept] + [pa.array([x[i] for x in found], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return urls.mapInArrow(run, schema)


FOLD = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}

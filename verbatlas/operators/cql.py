"""Token sequences in a corpus: conditions on neighbouring tokens, given as data.

A pattern is a list of segments, one for each token in a row; a segment is a list of tests that its token has to pass.
`token(surface="the")`, `token(pos="ADJ", number="sg")` and `token().but(pos="PUNCT")` make segments.

Tests become Column predicates. Three plans give the same matches: `in_documents` works on a document's
array of tokens, so nothing is shuffled; `by_lead` sorts a token table once for any number of segments;
`by_join` joins it to itself, which pays where the first segment is rare.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbatlas.functions import text as X

#: Columns that compare without regard to case; any other name is a key of the features.
COLUMNS = ("surface", "lemma", "pos")


@dataclass(frozen=True)
class Test:
    name: str
    value: str
    equal: bool = True


@dataclass(frozen=True)
class Segment:
    """The tests of one token; without any, every token fits."""

    tests: tuple[Test, ...] = ()

    def but(self, **values: str) -> Segment:
        """The segment, where the named values must differ."""
        return Segment(self.tests + tuple(Test(n, v, False) for n, v in values.items()))


Pattern = list[Segment]


def token(**values: str) -> Segment:
    """A token with these values of surface, lemma, pos or features."""
    return Segment(tuple(Test(n, v) for n, v in values.items()))


def _condition(segment: Segment, value: Callable[[str], Column]) -> Column:
    """value gives a token's lemma, pos, surface or the feature of another name; a missing feature fits nothing."""

    def one(t: Test) -> Column:
        have, want = value(t.name), t.value
        if t.name in COLUMNS:
            have, want = F.lower(have), want.lower()
        return have == want if t.equal else have != want

    return reduce(lambda x, y: x & y, map(one, segment.tests), F.lit(True))


def _of_token(segment: Segment, surface: Column) -> Column:
    """The segment's tests on a surface form. Tests of the surface itself come first; the analysis is made once, and only for what they leave."""
    cheap = Segment(tuple(t for t in segment.tests if t.name == "surface"))
    rest = Segment(tuple(t for t in segment.tests if t.name != "surface"))
    own = _condition(cheap, lambda _: surface)
    # most tokens lack a letter of the lemma that is asked for, and are not analysed
    own = reduce(lambda x, y: x & y, (X.may_have_lemma(surface, t.value) for t in rest.tests if t.name == "lemma" and t.equal), own)
    if not rest.tests:
        return own

    def analysed(a: Column) -> Column:
        return _condition(rest, lambda name: a[name] if name in COLUMNS else F.str_to_map(a["feats"], F.lit("\\|"), F.lit("="))[name])

    return own & X.named(X.analysis(surface), analysed)


def in_documents(docs: DataFrame, pattern: Pattern, *keep: str, payload: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """doc_id, any columns to keep, sentence_no, match_start, match_end over documents (doc_id, text).

    payload makes a further column of the token array and the index of a match. It is made before matches become rows, so
    no row carries a whole document. Documents without a surface form that the pattern asks for are dropped before they are cut into tokens.
    """
    n, t = len(pattern), F.col("all_tokens")
    if not n:
        raise ValueError("a pattern needs a segment")
    # only ASCII: the lower case of other letters may depend on what stands beside them
    asked = {x.value.lower() for s in pattern for x in s.tests if x.name == "surface" and x.equal and x.value.isascii()}
    for word in sorted(asked):
        docs = docs.filter(F.contains(F.lower("text"), F.lit(word)))
    rows = docs.select("doc_id", *keep, X.tokens(F.col("text")).alias("all_tokens"))

    def fits(i: Column) -> Column:
        at = [F.get(t, i + k) for k in range(n)]
        # segments with a surface first, then those with a lemma: they are cheap and most tokens fail them
        order = sorted(range(n), key=lambda k: min((("surface", "lemma").index(x.name) for x in pattern[k].tests if x.equal and x.name in ("surface", "lemma")), default=2))
        own = reduce(lambda x, y: x & y, (_of_token(pattern[k], at[k]["surface"]) for k in order))
        return own & (at[0]["sentence_no"] == at[n - 1]["sentence_no"])

    def hit(i: Column) -> Column:
        more = [payload(t, i).alias("payload")] if payload else []
        return F.struct(F.get(t, i)["sentence_no"].alias("sentence_no"), i.alias("match_start"), (i + n - 1).alias("match_end"), *more)

    # short documents have no start at all: a filter on the array's size would be pushed below the tokens and make them twice
    starts = F.filter(F.when(F.size(t) >= n, F.sequence(F.lit(0), F.size(t) - n)), fits)
    hits = rows.select("doc_id", *keep, F.explode(F.transform(starts, hit)).alias("hit"))
    return hits.select("doc_id", *keep, "hit.*")


def _of_row(value: Callable[[str], Column]) -> Callable[[str], Column]:
    return lambda name: value(name) if name in COLUMNS else F.get_json_object(value("feats"), f"$.{name}")


def by_lead(tokens: DataFrame, pattern: Pattern, sentence: list[str]) -> DataFrame:
    """Matches over a token table (sentence columns, token_index, and the columns that the pattern names).

    feats is JSON text. Later tokens are read by lead, after one sort by sentence.
    """
    order = Window.partitionBy(*sentence).orderBy("token_index")
    needed = {x.name for s in pattern for x in s.tests}
    columns = [c for c in (*COLUMNS, "feats") if c in tokens.columns and (c in needed or c == "feats" and needed - set(COLUMNS))]
    row = F.struct("token_index", *columns)
    ahead = tokens.select(*sentence, "token_index", *[F.lead(row, k).over(order).alias(f"t{k}") if k else row.alias("t0") for k in range(len(pattern))])
    fits = reduce(lambda x, y: x & y, (_condition(s, _of_row(lambda name, k=k: F.col(f"t{k}.{name}"))) for k, s in enumerate(pattern)))
    together = reduce(lambda x, y: x & y, [F.col(f"t{k}.token_index") == F.col("token_index") + k for k in range(len(pattern))])
    return ahead.filter(fits & together).select(*sentence, F.col("token_index").alias("match_start"), (F.col("token_index") + len(pattern) - 1).alias("match_end"))


def by_join(tokens: DataFrame, pattern: Pattern, sentence: list[str]) -> DataFrame:
    """The same by equi-joins on the sentence and the next index; each side is filtered before it is joined."""
    found = None
    for k, s in enumerate(pattern):
        own = tokens.filter(_condition(s, _of_row(F.col))).select(*sentence, (F.col("token_index") - k).alias("match_start"))
        found = own if found is None else found.join(own, [*sentence, "match_start"])
    return found.withColumn("match_end", F.col("match_start") + len(pattern) - 1)


def page(matches: DataFrame, order: list[str], number: int, size: int) -> DataFrame:
    """One page in order, and has_more: whether a row follows it. One row more than the page is read, no count is made."""
    number, size = max(1, number), min(100, max(1, size))
    rows = matches.orderBy(*order).offset((number - 1) * size).limit(size + 1)
    place = Window.orderBy(*order)
    counted = rows.withColumn("place", F.row_number().over(place)).withColumn("has_more", F.count("*").over(Window.partitionBy()) > size)
    return counted.filter(F.col("place") <= size).drop("place")

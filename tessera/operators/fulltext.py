"""Full-text search over postings: terms, prefixes, columns, phrases, NEAR, AND, OR, NOT; snippets and offsets."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.shims import LOWER, UPPER
from tessera.plans.lexer import SqlError

#: Tokens of the simple tokenizer: ASCII letters and digits, and every character beyond ASCII.
TOKEN = r"[0-9A-Za-z\x80-\x{10FFFF}]+"
_PY_TOKEN = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
NEAR_DEFAULT = 10


def fold(s: str) -> str:
    return s.translate({c: c + 32 for c in range(65, 91)})


def _measure(stem: str) -> int:
    return len(re.findall("vc", re.sub("c+", "c", re.sub("v+", "v", _shape(stem)))))


def _shape(word: str) -> str:
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in "aeiou" or c == "y" and i > 0 and out[-1] == "c" else "c"
    return out


def porter(word: str) -> str:
    """Porter's stemmer (1980), steps 1 to 5, for ASCII words of three letters or more."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word

    def has_vowel(s: str) -> bool:
        return "v" in _shape(s)

    def double(s: str) -> bool:
        return len(s) > 1 and s[-1] == s[-2] and _shape(s)[-1] == "c"

    def cvc(s: str) -> bool:
        return len(s) > 2 and _shape(s)[-3:] == "cvc" and s[-1] not in "wxy"

    def swap(s: str, rules: tuple[tuple[str, str], ...], least: int) -> str:
        for end, new in rules:
            if s.endswith(end):
                stem = s[: -len(end)]
                return stem + new if _measure(stem) > least else s
        return s

    w = word
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: -len(end)] + new
            break
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and cvc(w):
                    w += "e"
                break
    if w.endswith("y") and has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = swap(w, (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("logi", "log"), ("bli", "ble"),
                 ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
                 ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")), 0)
    w = swap(w, (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")), 0)
    if w.endswith("ion") and len(w) > 3 and w[-4] in "st":
        w = w[:-3] if _measure(w[:-3]) > 1 else w
    else:
        ends = "ement ance ence able ible ment ant ent ism ate iti ous ive ize al er ic ou".split()
        w = swap(w, tuple((e, "") for e in ends), 1)
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not cvc(w[:-1]):
            w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


@dataclass(frozen=True)
class Phrase:
    terms: tuple[tuple[str, bool], ...]  # term, is a prefix
    column: str | None = None


def parse_match(query: str, column: str | None = None):
    """("and"|"or"|"not", a, b), ("near", phrases, distances) or a Phrase.  OR binds less than AND, AND less than NOT."""
    tokens = re.findall(r'"[^"]*"|\(|\)|[^\s()"]+', query)
    at = 0

    def terms(text: str) -> tuple[tuple[str, bool], ...]:
        return tuple((fold(m[0]), text[m.end() : m.end() + 1] == "*") for m in _PY_TOKEN.finditer(text))

    def phrase():
        nonlocal at
        t, only = tokens[at], column
        at += 1
        if t == "(":
            e = either()
            if at >= len(tokens) or tokens[at] != ")":
                raise SqlError(f"malformed MATCH expression: [{query}]")
            at += 1
            return e
        m = re.match(r"([A-Za-z_]\w*):(.*)", t)
        if m:
            only, t = m[1], m[2]
            if not t and at < len(tokens):
                t = tokens[at]
                at += 1
        found = terms(t.strip('"') if t.startswith('"') else t)
        return Phrase(found, only)

    def near():
        nonlocal at
        parts, distances = [phrase()], []
        while at < len(tokens) and re.fullmatch(r"NEAR(/\d+)?", tokens[at]):
            distances.append(int(tokens[at][5:]) if "/" in tokens[at] else NEAR_DEFAULT)
            at += 1
            parts.append(phrase())
        return ("near", parts, distances) if distances else parts[0]

    def without():
        nonlocal at
        left = near()
        while at < len(tokens) and tokens[at] == "NOT":
            at += 1
            left = ("not", left, near())
        return left

    def both():
        nonlocal at
        left = without()
        while at < len(tokens) and tokens[at] not in (")", "OR"):
            if tokens[at] == "AND":
                at += 1
            left = ("and", left, without())
        return left

    def either():
        nonlocal at
        left = both()
        while at < len(tokens) and tokens[at] == "OR":
            at += 1
            left = ("or", left, both())
        return left

    if not tokens:
        raise SqlError(f"malformed MATCH expression: [{query}]")
    out = either()
    if at < len(tokens):
        raise SqlError(f"malformed MATCH expression: [{query}]")
    return out


def phrases_of(e) -> list[Phrase]:
    if isinstance(e, Phrase):
        return [e]
    if e[0] == "near":
        return [p for p in e[1]]
    return phrases_of(e[1]) + (phrases_of(e[2]) if e[0] != "not" else [])


class FullText:
    """A full-text index of columns of a DataFrame.

    Postings are (docid, col, pos, term), one row a token, made by built-in functions.
    Every operator is a filter, join, union or anti-join over them, so rare terms move
    little: each term is filtered before anything is joined, and cells without the term
    are dropped before they are taken apart.
    """

    def __init__(self, df: DataFrame, docid: str, columns: list[str], stem: bool = False, postings: DataFrame | None = None):
        self.df, self.docid, self.columns, self.stem, self._postings = df, docid, columns, stem, postings

    def save(self, path: str) -> FullText:
        """Writes the postings in order of terms, so that a term's filter skips all other row groups, and uses them from now on."""
        self.postings().repartitionByRange("term", "docid").sortWithinPartitions("term", "docid").write.mode("overwrite").parquet(path)
        return FullText(self.df, self.docid, self.columns, self.stem, self.df.sparkSession.read.parquet(path))

    def tokens(self, holds: str | None = None) -> DataFrame:
        """(docid, col, pos, raw, term) of every token; with ``holds`` only of cells that have that string, in any case."""
        parts = []
        for i, c in enumerate(self.columns):
            words = F.regexp_extract_all(F.coalesce(F.col(c), F.lit("")), F.lit(f"({TOKEN})"), F.lit(1))
            rows = self.df
            if holds is not None:
                rows = rows.filter(F.translate(F.col(c), UPPER, LOWER).contains(holds))  # before anything is exploded
            parts.append(rows.select(F.col(self.docid).alias("docid"), F.lit(i).alias("col"), F.posexplode(words).alias("pos", "raw")))
        all_ = reduce(DataFrame.unionAll, parts)
        return all_.withColumn("term", F.translate("raw", UPPER, LOWER))

    def postings(self, holds: str | None = None) -> DataFrame:
        if self._postings is not None:
            return self._postings
        out = self.tokens(None if self.stem else holds).select("docid", "col", "pos", "term")
        if not self.stem:
            return out

        @F.pandas_udf("string")
        def stemmed(s: pd.Series) -> pd.Series:
            known = {w: porter(w) for w in s.unique()}
            return s.map(known)

        return out.withColumn("term", stemmed("term"))

    def _term(self, term: str, prefix: bool, column: str | None) -> DataFrame:
        p = self.postings(term)
        p = p.filter(F.col("term").startswith(term) if prefix else F.col("term") == (porter(term) if self.stem else term))
        if column is not None:
            low = [c.lower() for c in self.columns]
            if column.lower() not in low:
                raise SqlError(f"no such column: {column}")
            p = p.filter(F.col("col") == low.index(column.lower()))
        return p.select("docid", "col", "pos")

    def hits(self, phrase: Phrase) -> DataFrame:
        """(docid, col, pos, last): where a phrase stands, from its first to its last position."""
        if not phrase.terms:
            return self.df.sparkSession.createDataFrame([], f"docid {self.df.schema[self.docid].dataType.simpleString()}, col int, pos int, last int")
        out = self._term(*phrase.terms[0], phrase.column)
        for k, (term, prefix) in enumerate(phrase.terms[1:], 1):
            then = self._term(term, prefix, phrase.column).select("docid", "col", (F.col("pos") - k).alias("pos"))
            out = out.join(then, ["docid", "col", "pos"], "left_semi")
        return out.withColumn("last", F.col("pos") + len(phrase.terms) - 1)

    def _evaluate(self, e) -> DataFrame:
        if isinstance(e, Phrase):
            return self.hits(e).select("docid").distinct()
        if e[0] == "near":
            left = self.hits(e[1][0])
            for phrase, n in zip(e[1][1:], e[2]):
                right = self.hits(phrase).select("docid", "col", F.col("pos").alias("pos2"), F.col("last").alias("last2"))
                close = (F.col("pos2") > F.col("last")) & (F.col("pos2") - F.col("last") - 1 <= n)
                close = close | (F.col("pos") > F.col("last2")) & (F.col("pos") - F.col("last2") - 1 <= n)
                left = left.join(right, ["docid", "col"]).filter(close).select("docid", "col", F.col("pos2").alias("pos"), F.col("last2").alias("last")).distinct()
            return left.select("docid").distinct()
        a, b = self._evaluate(e[1]), self._evaluate(e[2])
        if e[0] == "and":
            return a.join(b, "docid", "left_semi")
        if e[0] == "or":
            return a.union(b).distinct()
        return a.join(b, "docid", "left_anti")

    def match(self, query: str, column: str | None = None) -> DataFrame:
        """(docid) of the documents that match."""
        return self._evaluate(parse_match(query, column))

    def _places(self, query: str, column: str | None) -> DataFrame:
        parts, k = [], 0
        for phrase in phrases_of(parse_match(query, column)):
            found = self.hits(phrase)
            for i in range(len(phrase.terms)):
                parts.append(found.select("docid", "col", (F.col("pos") + i).alias("pos"), F.lit(k).alias("term")))
                k += 1
        return reduce(DataFrame.unionAll, parts).join(self.match(query, column), "docid", "left_semi")

    def offsets(self, query: str, column: str | None = None) -> DataFrame:
        """(docid, offsets): for each hit its column, term number, byte offset and size, as one text."""
        places = self._places(query, column)
        parts = []
        for i, c in enumerate(self.columns):
            split = F.regexp_extract_all(F.coalesce(F.col(c), F.lit("")), F.lit(f"((?:(?!{TOKEN}).)*+)({TOKEN})".replace("(?:(?!", "(?s:(?!")), F.lit(0))
            parts.append(self.df.select(F.col(self.docid).alias("docid"), F.lit(i).alias("col"), F.posexplode(split).alias("pos", "part")))
        pieces = reduce(DataFrame.unionAll, parts).join(places.select("docid").distinct(), "docid", "left_semi")
        word = F.regexp_extract("part", f"({TOKEN})$", 1)
        upto = F.sum(F.octet_length("part")).over(Window.partitionBy("docid", "col").orderBy("pos"))
        sized = pieces.withColumn("size", F.octet_length(word)).withColumn("at", upto - F.col("size"))
        rows = places.join(sized, ["docid", "col", "pos"]).select("docid", F.struct("col", "at", "term", "size").alias("h"))
        quads = F.transform(
            F.array_sort(F.collect_list("h")), lambda h: F.concat_ws(" ", h["col"], h["term"], h["at"], h["size"])
        )
        return rows.groupBy("docid").agg(F.array_join(quads, " ").alias("offsets"))

    def matchinfo(self, query: str, column: str | None = None) -> DataFrame:
        """(docid, term, col, hits, all_hits, docs_with_hits): per document, term and column, as the default format holds."""
        places = self._places(query, column)
        here = places.groupBy("docid", "term", "col").agg(F.count(F.lit(1)).alias("hits"))
        parts = []
        for k, (phrase, i) in enumerate((p, i) for p in phrases_of(parse_match(query, column)) for i in range(len(p.terms))):
            parts.append(self.hits(phrase).select("docid", "col", F.lit(k).alias("term")))
        everywhere = reduce(DataFrame.unionAll, parts).groupBy("term", "col").agg(
            F.count(F.lit(1)).alias("all_hits"), F.countDistinct("docid").alias("docs_with_hits")
        )
        return here.join(everywhere, ["term", "col"]).select("docid", "term", "col", "hits", "all_hits", "docs_with_hits")

    def matchinfo_blob(self, query: str, letters: str = "pcx", column: str | None = None) -> DataFrame:
        """(docid, matchinfo): 32-bit little-endian numbers for each letter of a format.

        p: phrases; c: columns; n: documents; a: mean tokens of each column; l: tokens of each
        column here; x: for each phrase and column the hits here, the hits in all documents
        and the documents with hits.
        """
        for f in letters:
            if f not in "pcnalx":
                raise SqlError(f"unrecognized matchinfo request: {f}")
        phrases, width = phrases_of(parse_match(query, column)), len(self.columns)
        out = self.match(query, column)
        numbers = []
        if set(letters) & set("nal"):
            count = lambda c: F.size(F.regexp_extract_all(F.coalesce(F.col(c), F.lit("")), F.lit(f"({TOKEN})"), F.lit(1)))
            sized = self.df.select(F.col(self.docid).alias("docid"), *[count(c).alias(f"l{i}") for i, c in enumerate(self.columns)])
            total = sized.agg(F.count(F.lit(1)).alias("n"), *[F.floor((F.sum(f"l{i}") + F.count(F.lit(1)) / 2) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias(f"a{i}") for i in range(width)])
            out = out.join(sized, "docid").crossJoin(F.broadcast(total))  # one row
        if "x" in letters:
            for k, phrase in enumerate(phrases):
                hits = self.hits(phrase).groupBy("docid", "col").agg(F.count(F.lit(1)).alias("h"))
                here = hits.groupBy("docid").agg(*[F.sum(F.when(F.col("col") == i, F.col("h"))).alias(f"h{k}_{i}") for i in range(width)])
                every = hits.agg(*[f(F.when(F.col("col") == i, F.col("h"))).alias(f"{n}{k}_{i}") for i in range(width) for n, f in (("t", F.sum), ("d", F.count))])
                out = out.join(here, "docid", "left").crossJoin(F.broadcast(every))  # one row
        for f in letters:
            numbers += {
                "p": [F.lit(len(phrases))], "c": [F.lit(width)], "n": [F.col("n")] if "n" in letters else [],
                "a": [F.col(f"a{i}") for i in range(width)], "l": [F.col(f"l{i}") for i in range(width)],
                "x": [F.col(f"{n}{k}_{i}") for k in range(len(phrases)) for i in range(width) for n in "htd"],
            }[f]
        digits = [F.lpad(F.hex(F.coalesce(v, F.lit(0)).cast("long")), 8, "0") for v in numbers]
        blob = F.unhex(F.concat(*[F.substring(d, at, 2) for d in digits for at in (7, 5, 3, 1)]))
        return out.select("docid", blob.alias("matchinfo"))

    def snippet(
        self, query: str, start: str = "<b>", end: str = "</b>", ellipsis: str = "<b>...</b>", column: int = -1, n_tokens: int = 15, only: str | None = None
    ) -> DataFrame:
        """(docid, snippet): the window of at most ``n_tokens`` tokens with most different terms, hits marked."""
        places = self._places(query, only)
        if column >= 0:
            places = places.filter(F.col("col") == column)
        width = abs(n_tokens)
        other = places.select("docid", "col", F.col("pos").alias("pos2"), F.col("term").alias("term2"))
        scored = (
            places.select("docid", "col", "pos").distinct().join(other, ["docid", "col"])
            .filter((F.col("pos2") >= F.col("pos")) & (F.col("pos2") < F.col("pos") + width))
            .groupBy("docid", "col", "pos").agg(F.countDistinct("term2").alias("n"), F.max("pos2").alias("to"))
        )
        best = scored.groupBy("docid").agg(F.max(F.struct("n", -F.col("col"), -F.col("pos"), "to")).alias("b")).select(
            "docid", (-F.col("b.col2")).alias("col"), (-F.col("b.col3")).alias("pos"), F.col("b.to").alias("to")
        )
        marks = places.groupBy("docid", "col").agg(F.collect_set("pos").alias("marks"))
        text = F.array(*[F.coalesce(F.col(c), F.lit("")) for c in self.columns])
        rows = best.join(marks, ["docid", "col"]).join(self.df.select(F.col(self.docid).alias("docid"), text.alias("texts")), "docid")

        @F.pandas_udf("string")
        def cut(texts: pd.Series, pos: pd.Series, to: pd.Series, marks: pd.Series) -> pd.Series:
            out = []
            for t, p, q, m in zip(texts, pos, to, marks):
                spans = [x.span() for x in _PY_TOKEN.finditer(t)]
                first = max(0, min(p - (width - (q - p + 1)) // 2, len(spans) - width))
                last = min(len(spans), first + width) - 1
                hit, parts = set(int(x) for x in m), []
                at = 0 if first == 0 else spans[first][0]
                for i in range(first, last + 1):
                    a, b = spans[i]
                    parts += [t[at:a], start if i in hit else "", t[a:b], end if i in hit else ""]
                    at = b
                parts.append(t[at:] if last == len(spans) - 1 else ellipsis)
                out.append(("" if first == 0 else ellipsis) + "".join(parts))
            return pd.Series(out, dtype=object)

        return rows.select("docid", cut(F.element_at("texts", F.col("col") + 1), "pos", "to", "marks").alias("snippet"))

    def optimize(self) -> str:
        return "Index already optimal"

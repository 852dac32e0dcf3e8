"""License scans: a positional rare-token index, with DataFrame functions only.

Templates are the words of known licence notices. The index of a template holds
its rarest words (highest IDF over all documents) with their positions. In a
document each such word that is found votes for the place where the notice would
begin (its position less the one in the template); places with enough votes are
the intersection of the postings by relative position. A place counts if the
template's mandatory key phrase stands at its relative position.

Two passes: the first counts, over all documents, in how many each word of the
templates occurs (a few hundred counts, bounded by the templates); the second
scans within rows, without a shuffle.

Defined cases: a null text counts as empty; texts without words have no labels
and score 0; ties in IDF are broken by the word; repeated rows are each
scanned; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import ascii_lower, own_columns

#: Everything below U+0080 that is neither a digit nor a letter divides words.
DIVIDES = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrase and label of the base places.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key: str  # mandatory phrase, a part of the text

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_at(self) -> int:
        w, k = self.words, self.key.split()
        return next(i for i in range(len(w)) if w[i:i + len(k)] == k)


#: Short notices of public licences, in lower case and without punctuation.
TEMPLATES = (
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "licensed under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted free of charge"),
    Template("apache", "licensed under the apache license version 2 0", "apache license"),
    Template("gpl", "licensed under the gnu general public license version 3", "general public license"),
    Template("lgpl", "gnu lesser general public license", "lesser general public license"),
    Template("agpl", "gnu affero general public license", "affero general public license"),
    Template("mpl", "subject to the terms of the mozilla public license", "mozilla public license"),
    Template("epl", "eclipse public license", "eclipse public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source"),
    Template("bsd", "released under the bsd license", "bsd license"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose", "modify and or distribute this software"),
    Template("cc-by", "creative commons attribution 4 0 international", "creative commons attribution"),
    Template("cc0", "creative commons zero", "commons zero"),
    Template("unlicense", "free and unencumbered software released into the public domain", "unencumbered software"),
)

#: Words of a template in the index, and the votes that a place needs.
RARE_WORDS = 3
VOTES = 2


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), DIVIDES), "")


def idf_counts(docs: DataFrame, templates=TEMPLATES, text_col: str = "text") -> dict[str, int]:
    """In how many documents each word of the templates occurs: a count over all rows, as many results as there are words."""
    vocabulary = sorted({w for t in templates for w in t.words})
    found = F.array_intersect(words(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))), F.array(*map(F.lit, vocabulary)))
    rows = docs.select(F.explode(found).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()
    return dict.fromkeys(vocabulary, 0) | {r["w"]: r["n"] for r in rows}


def rare_index(counts: dict[str, int], templates=TEMPLATES, rare: int = RARE_WORDS) -> list[list[tuple[str, int]]]:
    """For each template its rarest words and their positions, the first of each word."""
    return [[(w, t.words.index(w)) for w in sorted(set(t.words), key=lambda w: (counts[w], w))[:rare]] for t in templates]


def held(a: Column, f) -> Column:
    """f of a, with a worked out once."""
    return F.get(F.transform(F.array(a), f), F.lit(0))


def stands(w: Column, at: Column, phrase: list[str]) -> Column:
    """Whether the phrase's words stand consecutively from position ``at`` (from 0; may be outside)."""
    out = at >= 0
    for k, x in enumerate(phrase):
        out = out & F.coalesce(F.get(w, at + k) == x, F.lit(False))
    return out


def _begins(phrase: list[str]):
    return lambda i: stands(F.col("w"), i, phrase)


def _votes(w: Column, hits: Column, word: str, offset: int) -> Column:
    return F.transform(F.filter(hits, lambda i: F.get(w, i) == word), lambda i: i - offset)


def _labelled(starts: Column, label: str) -> Column:
    return F.transform(starts, lambda s: F.struct(F.lit(label).alias("label"), s.cast("long").alias("start")))


def places(w: Column, hits: Column, postings: list[tuple[str, int]], t: Template) -> Column:
    """Places of a template: starts with enough votes, and the key phrase at its relative position."""
    votes = F.flatten(F.array(*[_votes(w, hits, x, o) for x, o in postings]))
    need = min(VOTES, len(postings))

    def enough(s: Column) -> Column:  # s is sorted; a start with n votes stands n times in a row
        return F.array_distinct(F.filter(s, lambda x, i: F.coalesce(F.get(s, i + (need - 1)) == x, F.lit(False))))

    return F.filter(held(F.array_sort(votes), enough), lambda s: stands(w, s + t.key_at, t.key.split()))


def share(w: Column, starts: Column, t: Template) -> Column:
    """The largest share of the template's words that stand in place at one of the starts."""
    def of(s: Column) -> Column:
        n = F.lit(0)
        for k, x in enumerate(t.words):
            n = n + F.when((s + k >= 0) & F.coalesce(F.get(w, F.greatest(s + k, F.lit(0))) == x, F.lit(False)), 1).otherwise(0)
        return n / F.lit(float(len(t.words)))

    return F.coalesce(F.array_max(F.transform(starts, of)), F.lit(0.0))


def scan(docs: DataFrame, templates=TEMPLATES, keep: list[str] | None = None, text_col: str = "text", counts: dict[str, int] | None = None) -> DataFrame:
    """The columns of ``keep`` (doc_id by default), n_words, n_base, first_word, last_word, base_labels,
    labels, score (the largest share of a notice found; 1 for a base phrase) and places (template label and start)."""
    keep = ["doc_id"] if keep is None else keep
    index = rare_index(idf_counts(docs, templates, text_col) if counts is None else counts, templates)
    firsts = [p.split()[0] for p, _ in PHRASES]
    look_up = sorted({w for p in index for w, _ in p} | set(firsts))
    w = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("own"), words(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).alias("w"))
    none = F.array().cast("array<int>")
    a = w.withColumn("hits", F.when(F.arrays_overlap("w", F.array(*map(F.lit, look_up))),
                                    F.filter(F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0))), lambda i: F.get(F.col("w"), i).isin(look_up))).otherwise(none))
    base = [F.filter("hits", _begins(p.split())) for p, _ in PHRASES]
    found = [places(F.col("w"), F.col("hits"), p, t) for p, t in zip(index, templates, strict=True)]
    b = a.select("own", F.when(F.size("hits") > 0, F.col("w")).otherwise(F.array().cast("array<string>")).alias("w"), F.size("w").cast("long").alias("n_words"),
                 F.array(*base).alias("base"), F.when(F.size("hits") > 0, F.array(*found)).alias("found"))
    labels = lambda names, col: F.flatten(F.array(*[
        F.when(F.size(F.get(F.col(col), F.lit(k))) > 0, F.array(F.lit(x))).otherwise(F.array().cast("array<string>")) for k, x in enumerate(names)]))
    every = F.flatten("base")
    base_labels = labels([x for _, x in PHRASES], "base")
    scores = [share(F.col("w"), F.get(F.col("found"), F.lit(k)), t) for k, t in enumerate(templates)]
    at = F.flatten(F.array(*[_labelled(F.coalesce(F.get(F.col("found"), F.lit(k)), none), t.label) for k, t in enumerate(templates)]))
    return b.select(
        "own.*", "n_words",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base_labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base_labels, labels([t.label for t in templates], "found")))), ",").alias("labels"),
        F.when(F.size(every) > 0, F.lit(1.0)).when(F.col("found").isNull(), F.lit(0.0)).otherwise(F.greatest(*scores)).alias("score"),
        at.alias("places"),
    )


def licenses(docs: DataFrame) -> DataFrame:
    """The contract's columns for every document."""
    return scan(own_columns(docs, "doc_id", "text")).drop("places")


def oracle(templates=TEMPLATES) -> str:
    """The same in DuckDB: words with positions, votes joined by relative position."""
    t = ",\n".join(f"({k}, '{t.label}', '{t.text}', '{t.key}', {t.key_at})" for k, t in enumerate(templates))
    return rf"""
WITH RECURSIVE t(k, label, words, key, key_at) AS (VALUES {t}),
tw AS (SELECT k, label, unnest(string_split(words, ' ')) AS word, generate_subscripts(string_split(words, ' '), 1) - 1 AS o, len(string_split(words, ' ')) AS n FROM t),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
w AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM d),
df AS (SELECT v.word, count(DISTINCT w.r) AS n FROM (SELECT DISTINCT word FROM tw) v LEFT JOIN w ON w.word = v.word GROUP BY v.word),
rare AS (SELECT k, word, o FROM (
  SELECT k, word, o, row_number() OVER (PARTITION BY k ORDER BY n, word) AS q FROM (
    SELECT tw.k, tw.word, min(tw.o) AS o, min(df.n) AS n FROM tw JOIN df ON df.word = tw.word GROUP BY tw.k, tw.word)) WHERE q <= {RARE_WORDS}),
place AS (SELECT w.r, rare.k, w.i - rare.o AS s FROM w JOIN rare ON rare.word = w.word GROUP BY ALL HAVING count(*) >= {VOTES}),
good AS (SELECT p.r, p.k, p.s FROM place p JOIN t ON t.k = p.k JOIN d ON d.r = p.r
         WHERE p.s + t.key_at >= 0 AND array_to_string(d.w[p.s + t.key_at + 1 : p.s + t.key_at + len(string_split(t.key, ' '))], ' ') = t.key),
sc AS (SELECT r, max(x) AS score FROM (SELECT g.r, g.k, g.s, count(w.i) / min(tw.n) AS x FROM good g JOIN tw ON tw.k = g.k
         LEFT JOIN w ON w.r = g.r AND w.i = g.s + tw.o AND w.word = tw.word GROUP BY g.r, g.k, g.s) GROUP BY r),
b AS (SELECT r, i, 'cc-by' AS label FROM d, unnest(range(1, len(w))) x(i) WHERE w[i] = 'cc' AND w[i + 1] = 'by'
      UNION ALL SELECT r, i, 'gpl' FROM d, unnest(range(1, len(w))) x(i) WHERE w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license'
      UNION ALL SELECT r, i, 'reserved' FROM d, unnest(range(1, len(w))) x(i) WHERE w[i] = 'all' AND w[i + 1] = 'rights' AND w[i + 2] = 'reserved'),
ba AS (SELECT r, count(*) AS n, min(i) - 1 AS f, max(i) - 1 AS l, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM b GROUP BY r),
al AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM b UNION SELECT g.r, t.label FROM good g JOIN t ON t.k = g.k) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(ba.n, 0) AS BIGINT) AS n_base, CAST(ba.f AS BIGINT) AS first_word, CAST(ba.l AS BIGINT) AS last_word,
       coalesce(ba.labels, '') AS base_labels, coalesce(al.labels, '') AS labels,
       CAST(CASE WHEN ba.n > 0 THEN 1.0 ELSE coalesce(sc.score, 0.0) END AS DOUBLE) AS score
FROM d LEFT JOIN ba USING (r) LEFT JOIN al USING (r) LEFT JOIN sc USING (r)
"""


ORACLE = oracle()

"""Small frames for the operators' tests."""

import random
from collections import Counter

from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"

#: Names that operators might use inside, as extra columns of their input.
CLASHES = (
    "id row_hash gone uid own line no n first place score bucket length piece rank k key a b s t node root copies keep_id keep_hash group_node u v part packed block bits once twice shard h word words rejected kept seconds bad "
    "lo hi first_bin at before bin_id bin_offset n_words p e ids offsets n_tokens template overlap fingerprint print n_paragraphs first_doc_id page_id url html __sx_own __sx_id __sx_hash __sx_stays __sx_copies __sx_new __sx_left __sx_url __sx_bucket col"
).split()


def docs(spark, rows, parts=2):
    """A frame of documents from (doc_id, text)."""
    full = [(i, t, "en", "src", None if t is None else len(t)) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def with_clashes(df):
    taken = set(df.columns)
    return df.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(CLASHES) if c not in taken])


def words(r, n, size=200):
    return " ".join(f"w{r.randrange(size)}" for _ in range(n))


LONG = "long " + "word " * 60_000

#: Nulls, empty and blank texts, a very long one, repeated rows and ids, and scripts of all kinds.
ODD = [
    (1, None), (2, ""), (3, " \n\t\n "), (4, "One line.\nTwo lines.\nOne line."), (4, "One line.\nTwo lines.\nOne line."), (5, "Two lines.\nOther."), (None, "Other.\nNo id here."), (None, None),
    (6, "日本語のテキスト。\nかな"), (7, "naïve café — œuvre 😀\r\nnext"), (8, LONG), (9, "\n\n"), (10, "x"), (11, "Other.\nTwo lines."), (5, "different text under a known id"),
]


def multiset(rows):
    return Counter(tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in rows)


def random_docs(seed, n=60, lines=25):
    r = random.Random(seed)
    return [(i, "\n".join(words(r, r.randrange(0, 4), 9) for _ in range(r.randrange(lines)))) for i in range(n)]

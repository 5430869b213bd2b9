"""Small frames for tests."""

from __future__ import annotations

import random

from pairforge.operators.keys import assign_text_ids
from pairforge.schemas import EMBEDDING, EXAMPLE


def example(seq, row, task, texts, roles, label=None, lang="en", teacher=None, student=None, ids=None):
    n = len(roles)
    return (
        seq, row, f"{task}-{row}", task, lang, texts, roles,
        teacher or ["document"] * n, student or ["document"] * n, label, ids,
    )


def frame(spark, rows, ids=True):
    df = spark.createDataFrame(rows, EXAMPLE)
    return assign_text_ids(df) if ids else df


def random_examples(spark, n, seed=0, sources=3, words=40):
    """Examples whose texts repeat often; source sizes differ and row numbers have gaps."""
    rng = random.Random(seed)
    rows, at = [], [0] * sources
    for _ in range(n):
        seq = rng.choice([0] * 4 + list(range(sources)))
        at[seq] += rng.randint(1, 3)
        k = rng.randint(2, 4)
        texts = [f"w{rng.randint(0, words)}" if rng.random() < 0.7 else "hot" for _ in range(k)]
        rows.append(
            example(seq, at[seq], "retrieval", texts, ["query", "positive"] + ["negative"] * (k - 2),
                    teacher=["web_search_query"] + ["document"] * (k - 1))
        )
    return frame(spark, rows)


def vectors(spark, table, kind="doc"):
    """(text_id -> list of floats) as an embeddings frame."""
    rows = [(t, [float(x) for x in v], kind) for t, v in table.items()]
    return spark.createDataFrame(rows, EMBEDDING)


def pairs_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())

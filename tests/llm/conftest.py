from __future__ import annotations

import random

import pytest

#: Extra columns whose names the operators use inside.
CLASHING = "id string, kept string, size string, rank string, stays string, text_sha256 string, component_id string, node string, score string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"


def rows_of(items):
    return [(i, t, "en", s, None if t is None else len(t), *["x"] * 9) for i, t, s in items]


@pytest.fixture(scope="session")
def docs_of(spark):
    """(doc_id, text, source) rows as a documents table with clashing extra columns."""
    return lambda items: spark.createDataFrame(rows_of(items), SCHEMA)


@pytest.fixture(scope="session")
def items():
    """Nulls, empty and long texts, ties, exact and near copies, repeated rows."""
    rng = random.Random(3)
    vocabulary = [f"{a}{b}" for a in "ka le mi so tu ra ne".split() for b in "lor dan vek ist um zzu éa 中文".split()]
    out = []
    for i in range(40):
        out.append((i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 5, 8, 30, 60, 200]))), rng.choice(["a", "b", "c", None])))
    for i in range(40, 70):  # near copies at every distance around the threshold
        words = out[rng.choice(range(40))][1].split()
        for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
            if words:
                words[rng.randrange(len(words))] = "changed"
        out.append((i, " ".join(words), "a"))
    out += [(70, None, None), (71, "", "b"), (72, "  \t\n", "b"), (73, None, "b"), (None, "null identifier here in this row", "a")]
    out += [(74, " ".join(rng.choice(vocabulary) for _ in range(6000)), "c"), (75, "x" * 30000, "c"), (76, "A B c d E f", "a"), (77, "a b C D e F", "a")]
    return out + [out[5], out[5], out[20]]

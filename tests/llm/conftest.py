import random

import pytest

WORDS = "the of and to in is that for it was on are be with as by at from this have or had not but what all were when we there can an your which their said if do will each".split()


def texts(n: int, seed: int = 0) -> list:
    """Texts with copies, near copies, shared passages, repeats within a text, odd white space and empty ones."""
    rng = random.Random(seed)
    some = lambda k: [rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(k)]
    passage, out = some(45), []
    for i in range(n):
        kind = i % 10
        if kind == 0 and out:
            out.append(out[rng.randrange(len(out))])
        elif kind == 1 and out and out[-1]:
            w = out[-1].split(" ")
            w[len(w) // 2] = "Changed"
            out.append(" ".join(w))
        elif kind == 2:
            out.append(" ".join([*some(20), *passage, *some(5)]))
        elif kind == 3:
            out.append(" ".join(some(rng.randrange(1, 8))))
        elif kind == 4:
            w = some(40)
            out.append(" ".join(w + ["x"] + w))
        elif kind == 5:
            out.append("\t ".join(w.capitalize() for w in some(60)) + "\n")
        else:
            out.append(" ".join(some(rng.randrange(30, 200))))
    return out


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls in every column, empty and long texts, repeated rows and columns with clashing names."""
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(texts(60))]
    rows += [(100, None, None, None), (101, "", "en", "s1"), (102, " \n\t ", "en", "s1"), (None, "null id words here to read again", "en", "s2"), (None, "null id words here to read again", "en", "s2"), (3, rows[3][1], "en", "s0"), (3, rows[3][1], "en", "s0")]
    rows += [(103, " ".join(f"w{i}" for i in range(30_000)), "en", "s2"), (104, "Été éTÉ ABC abc \U0001f600  x", "fr", None)]
    clash = "hash long, size string, shard int, _chunk string, key string, rank int, _text string, score string, copies int, slot int, place int, whole int, n_words string, own int, row string"
    data = [(*r, len(r[1]) if r[1] else None, *([None] * 15)) for r in rows]
    return spark.createDataFrame(data, f"doc_id long, text string, lang string, source string, n_chars long, {clash}").repartition(3)


def collected(df) -> list:
    return sorted((tuple(r) for r in df.collect()), key=repr)

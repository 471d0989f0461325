"""Small tables with everything that may go wrong in them."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, row long, g string, n long, component_id string, __row_ long, mark array<int>, keep_id string, id string, ord string"


def docs(spark, texts, ids=None):
    """Documents with columns whose names the operators use themselves."""
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", 0, False, 5, "g", 1, "c", 2, [1], "k", "i", "o") for i, t in zip(ids, texts, strict=True)], SCHEMA)


def corpus(seed=0, n=60, words="alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()):
    """Texts with nulls, empties, white space only, copies, near copies, shared passages, repetitions and a very long one."""
    rnd = random.Random(seed)
    text = lambda k: " ".join(rnd.choice(words) + (str(rnd.randrange(40)) if rnd.random() < 0.5 else "") for _ in range(k))
    passage = text(40)
    out = [None, "", " \t\n", "one", "One  two\nthree", "ONE TWO three", "ünï çödé 中文 😀 " * 30, "a " * 500, "abcab" * 300, text(8000)]
    for k in range(n):
        kind = k % 6
        if kind == 0 and len(out) > 12:
            base = [t for t in out if t]
            out.append(rnd.choice(base).replace(" ", "\n", 1))
        elif kind == 1 and len(out) > 12:
            w = rnd.choice([t for t in out if t and len(t.split()) > 30][-8:]).split()
            w[rnd.randrange(len(w))] = "changed"
            out.append(" ".join(w))
        elif kind == 2:
            out.append(f"{text(20)} {passage}\x0b{text(10)}")
        else:
            out.append(text(rnd.choice([3, 5, 20, 80, 120])))
    return out

"""Small documents with every awkward case: nulls, empties, ties, repeats, copies, near copies, one very long text."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `Text` string, key string"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def documents(seed=0, n=60):
    """Rows of SCHEMA (which has extra columns with clashing names)."""
    rng = random.Random(seed)
    texts = [" ".join(words(rng, rng.randrange(1, 160))) for _ in range(n)]
    passage = words(rng, 70)
    for i in range(8):  # a shared passage
        w = texts[i * 3].split()
        texts[i * 3] = " ".join(w[:20] + passage + w[20:])
    base = words(rng, 120)
    for i in range(14):  # near copies of one text, some of them only through others
        w = list(base)
        for _ in range(i):
            w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
        texts.append(" ".join(w))
    texts += [texts[0], texts[0], texts[1].upper().replace(" ", "\n"), "one two three", "ONE two\tthree", "one two", "", "   ", None, "a" * 3000, " ".join(words(rng, 9000, 5000))]
    rows = [(i, t, "en", None if i % 11 == 0 else f"src{i % 4}", len(t or ""), "other", "k") for i, t in enumerate(texts)]
    rows.append(rows[3])  # a repeated row
    rows.append((5, "another text of a repeated id that has some six words", "en", "src1", 5, None, None))
    rows.append((None, texts[0], "en", "src1", 5, None, None))
    rng.shuffle(rows)
    return rows

import math
import os
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from mosaik.llm import lm_scoring as L

os.environ["TOKENIZERS_PARALLELISM"] = "false"
FILE = public_tokenizers.path("byte_bpe_50k.json")


def plain(docs, target):
    """Both models and all losses straight from the definition."""
    tk = Tokenizer.from_file(FILE)
    grams = lambda t: list(zip(ids := [L.EDGE, *tk.encode(t or "", add_special_tokens=False).ids, L.EDGE], ids[1:]))

    def model(texts):
        pair = Counter(g for t in texts for g in grams(t))
        v, w = Counter(), Counter()
        for (a, b), n in pair.items():
            v[a] += n
            w[b] += n
        total = sum(pair.values())

        def loss(g):
            low = (w[g[1]] + 1) / (total + L.VOCABULARY)
            return -math.log(L.MIX * pair[g] / v[g[0]] + (1 - L.MIX) * low if v[g[0]] else low)

        return loss

    t, b = model(target), model([x for _, x in docs])
    out = []
    for d, x in docs:
        g = grams(x)
        lt, lb = sum(map(t, g)) / len(g), sum(map(b, g)) / len(g)
        out.append((d, len(g), lt, lb, lt - lb))
    return out


@pytest.mark.parametrize("sent", [10**9, 20, 0])
@pytest.mark.parametrize("target", [["hello there, how are you?", "fine and you", None, ""], []])
def test_sent_and_joined_bigrams_give_the_plain_scores(spark, sent, target):
    rows = [(1, "hello there you"), (2, None), (3, ""), (4, "numbers 1 2 3\n\n and  more"), (4, "same id"), (5, "twice"), (5, "twice"), (None, "no id"), (6, "a b c " * 3000)]
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, ids int")
    conversations = spark.createDataFrame([(t,) for t in target], "text string")
    got = sorted(map(tuple, L.cross_entropy_difference(docs, conversations, FILE, sent).collect()), key=str)
    want = sorted(plain(rows, target), key=str)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [x for g in got for x in g[2:]] == pytest.approx([x for w in want for x in w[2:]], abs=1e-9)


def test_driver_tables(spark, sf_dir):
    docs, talk = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "conversations"))
    want = {r[0]: r for r in plain([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in talk.collect()])}
    got = L.cross_entropy_difference(docs, talk, FILE).collect()
    assert len(got) == len(want)
    for r in got:
        assert tuple(r) == pytest.approx(want[r.doc_id], abs=1e-9)
    assert L.cross_entropy_difference(docs.limit(0), talk, FILE).count() == 0

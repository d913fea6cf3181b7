import random
import re
import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
from test_decontamination import brute as contaminated
from test_quality_rules import base
from test_secrets import brute_base
from test_simhash import brute_components, brute_print, brute_similar
from tokenizers import Tokenizer


def test_against_brute_force(spark, tmp_path):
    rng = random.Random(8)
    vocab = [f"w{k}" for k in range(400)]
    say = lambda n: " ".join(rng.choices(vocab, k=n))
    item = say(20)
    docs = [(k, say(rng.randrange(60, 300))) for k in range(40)]
    docs += [(50, docs[3][1]), (51, docs[4][1] + " tail"), (52, say(60) + " " + item), (53, say(70) + " token: 0123456789abcdef01234567 " + say(20)), (54, "too short"), (55, None), (56, "x y z " * 100), (53, docs[0][1]), (57, say(1500) + " " + item + " " + say(900))]
    docs += [(600 + k, " ".join(rng.choice(vocab[:12]) + "&&&" for _ in range(90))) for k in range(20)]
    docs.append((None, say(80)))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = left.columns
    rows = lambda: sorted(((r.doc_id, r.text) for r in left.collect()), key=str)
    stages = dict(corpus_pipeline.STAGES)

    left = stages["quality_rules"](spark, left, str(tmp_path))
    kept = [(i, t) for i, t in docs if not base(t)[-1]]
    assert rows() == sorted((x for x in kept if not (x[0] and x[0] >= 600)), key=str) and left.columns == columns
    left = stages["simhash_dedup"](spark, left, str(tmp_path))
    found = sorted(((r.doc_id, r.text) for r in left.collect()), key=str)
    kept = [(i, t) for i, t in kept if i is None or i < 600]
    prints = {(i, t): brute_print(t) for i, t in kept}
    group = brute_components(prints)
    for a in prints:
        for b in prints:
            if group[a] != group[b] and brute_similar(a[1], b[1]) >= 0.8:
                group = {k: group[a] if g == group[b] else g for k, g in group.items()}
    members = [[k for k in prints if group[k] == g] for g in set(group.values())]
    least = [min((i for i, _ in m if i is not None), default=None) for m in members]
    assert len(found) == len(members) and sorted((i for i, _ in found), key=str) == sorted(least, key=str) and left.columns == columns
    assert all(x in prints for x in found)
    before = rows()
    left = stages["decontamination"](spark, left, str(tmp_path))
    # a long document that quotes a whole item in under 5 % of its words goes, too
    assert not contaminated(dict(docs)[57], [(1, item)])[3] and 57 in {r[0] for r in before}
    assert rows() == [x for x in before if not contaminated(x[1], [(1, item)])[1]] and not {52, 57} & {r[0] for r in rows()}
    before = rows()
    left = stages["secrets"](spark, left, str(tmp_path))
    hidden = lambda t: re.sub(r"token: 0123456789abcdef01234567", "[SECRET]", t) if brute_base(t) else t
    assert rows() == sorted(((i, hidden(t)) for i, t in before), key=str) and left.columns == columns
    last = {(r.doc_id): r.text for r in left.collect()}
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: [*t.encode(x, add_special_tokens=False).ids, 1] for i, x in last.items()}
    pieces = defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32
        pieces[r.doc_id].append((r.start, r.length))
    assert {i: sum(n for _, n in p) for i, p in pieces.items()} == {i: len(x) for i, x in want.items()}


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

"""The pipeline's stages, each against a brute-force version on what the stage before it kept."""

import hashlib
import re
from collections import Counter

import pytest

import corpus_pipeline
from tessera.llm import bpe, secret_scan, toxicity
from tessera.llm.common import materialise, table
from test_exact import WORD, brute_components

SF = "/root/testdata/sf0.01"  # the smallest table whose labels teach anything

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def test_stages(spark):
    docs = table(spark, SF, "documents")
    labels = table(spark, SF, "labels")
    stage = dict(corpus_pipeline.STAGES)
    kept = [materialise(stage["toxicity"](spark, docs, SF))]
    model = toxicity.fit(docs, labels)
    plain = [r for r in rows_of(docs) if sum(model.weights.get(f, 0.0) for f in toxicity.words_of(r[1])) + model.bias < -0.8472978603872037]
    assert rows_of(kept[0]) == plain and len(plain) < docs.count()  # ln(0.3 / 0.7)

    kept.append(materialise(stage["jaccard_join"](spark, kept[0], SF)))
    groups = brute_components({r[0]: r[1] for r in plain})
    want = [r for r in plain if groups[r[0]][1] == r[0]]
    assert rows_of(kept[1]) == want and len(want) < len(plain)

    kept.append(materialise(stage["secret_scan"](spark, kept[1], SF)))
    clean = [(r[0], redacted(r[1]), r[2], r[3], len(redacted(r[1]))) for r in want]
    changed = [(a, b) for a, b in zip(want, clean, strict=True) if a[1] != b[1]]
    assert rows_of(kept[2]) == sorted((b if a[1] != b[1] else a for a, b in zip(want, clean, strict=True)), key=repr)
    assert changed

    kept.append(materialise(stage["mixing"](spark, kept[2], SF)))
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in rows_of(kept[2])}
    totals, mixed = Counter(), Counter()
    for r in rows_of(kept[2]):
        totals[r[3]] += size[r[0]]
    for r in rows_of(kept[3]):
        mixed[r[3]] += size[r[0]]
    assert set(rows_of(kept[3])) <= set(rows_of(kept[2]))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(totals))}
    goal, left = {}, 1.5 * sum(totals.values())
    for s in sorted(totals, key=lambda s: 2 * totals[s] / weight[s]):
        goal[s] = min(2.0 * totals[s], left * weight[s] / sum(weight[x] for x in totals if x not in goal))
        left -= goal[s]
    assert all(abs(mixed[s] - goal[s]) <= max(size.values()) for s in totals)

    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_path())
    want = Counter()
    for r in rows_of(kept[3]):
        ids = lib.encode(r[1] or "", add_special_tokens=False).ids
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), lib.decode(ids, skip_special_tokens=False))]
        want[r[0], len(ids), *digests] += 1
    for out in (stage["bpe"](spark, kept[3], SF), corpus_pipeline.run(spark, SF)):
        assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect()) == want


def redacted(text):
    """Overlapping spans are one gap, named by the first."""
    low = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    found = [(m.start(), 0, "assign", m.end()) for m in low.finditer(text or "") if len(m[2]) >= 8]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]{12,}", text or "")]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]{32,}", text or "")]
    out, at = "", 0
    for start, _, kind, end in sorted(found):
        if start >= at:
            out += text[at:start] + f"[REDACTED:{kind}]"
        at = max(at, end)
    return out + (text or "")[at:]


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None), (1, "a b c", "en", None, 5), (1, "a b c", "en", None, 5), (2, "", None, "s", 0), (None, "secret: abcdefgh12", "en", "s", 18)]])
def test_odd_tables(spark, tmp_path, rows):
    """Empty tables, null ids, texts and sources, and repeated rows pass every stage."""
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert bool(out) == bool(rows) and {r.doc_id for r in out} <= {None, 1, 2}
    assert secret_scan.RULES

import hashlib
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from faultline.llm import langid
from faultline.session import materialize

from .conftest import awkward_rows
from .test_mixing import brute as brute_mix
from .test_simhash import brute_components, brute_fingerprint


def brute(rows, identified):
    """(doc_id, text, source) rows that reach each stage, with repeats, and the encoded rows."""
    kept = [r for r in rows if identified(r[1])]
    best = {}
    for r in kept:
        if r[1] not in best or (r[0] is not None and (best[r[1]][0] is None or r[0] > best[r[1]][0])):
            best[r[1]] = r
    unique = list(best.values())
    comp = brute_components([brute_fingerprint(r[1]) for r in unique])
    groups = {}
    for r in unique:
        groups.setdefault(comp[brute_fingerprint(r[1])], []).append(r)
    lone = [min(g, key=lambda r: (r[0] is None, r[0])) for g in groups.values()]
    taken = {(i, n): t // n for i, n, _, _, t in brute_mix(lone, lambda i: i % 3 + 1) if n}
    mixed = Counter({r[0]: taken[r[0], len(r[1].split())] for r in lone})
    return len(kept), len(unique), len(lone), mixed


def library_digests(texts):
    tok = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    tok.no_truncation()
    tok.no_padding()
    out = {}
    for i, t in texts.items():
        ids = tok.encode(t, add_special_tokens=False).ids
        out[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                  hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    return out


def test_stages_are_the_dealt_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "SimHash near-dedup", "mixing sources to target weights", "BPE encoding and decoding"]


def test_run_equals_brute_force(spark, sf, small_docs):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lab = langid.Labeller(langid.train(docs))
    identified = lambda t: (x := lab.documents([t or ""])[0])[0] != "und" and x[1] >= langid.MIN_SCORE
    *_, mixed = brute([(d["doc_id"], d["text"], d["source"]) for d in small_docs], identified)
    want = library_digests({d["doc_id"]: d["text"] for d in small_docs if mixed[d["doc_id"]]})
    got = corpus_pipeline.run(spark, sf).collect()
    assert Counter(r.doc_id for r in got) == +mixed
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want


@pytest.mark.parametrize("table", ["awkward", "nothing"])
def test_stages_keep_the_columns(spark, sf, table, request):
    docs = request.getfixturevalue(table)
    columns = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = materialize(stage(spark, docs, sf), f"t{i}")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    texts = {r[0]: r[1] for r in awkward_rows() if r[1] and any(map(str.isalpha, r[1]))}
    assert docs.count() == 0 if table == "nothing" else {r.doc_id for r in docs.collect()} <= set(texts)

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from palisade.llm import bpe, quality_cnn
from palisade.llm.common import stash, table

from .test_line_dedup import brute as brute_lines
from .test_mixing import targets
from .test_ngram_join import brute as brute_groups

SF = "/root/testdata/sf0.001"


def test_every_stage_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    columns, steps = docs.columns, []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stash(stage(spark, docs, SF), "test")
        steps.append((before.collect(), docs.collect()))
        assert number == 4 or docs.columns == columns

    # Classifier: what the network scores 0.7 or more.
    before, after = steps[0]
    net = quality_cnn.train(table(spark, SF, "documents"), table(spark, SF, "labels"))
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if net.score([r.text.encode()])[0] >= 0.7)
    label = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    clean = [r.doc_id for r in before if label.get(r.doc_id) == 1]
    assert len(set(clean) & {r.doc_id for r in after}) >= 0.9 * len(clean)

    # Lines: every document stays, with the text that brute force leaves.
    before, after = steps[1]
    want = {i: sha for i, _, _, sha in brute_lines([(r.doc_id, r.text) for r in before])}
    assert {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in after} == want
    assert all(r.n_chars == len(r.text) for r in after)

    # Near-duplicates: the least of each group, and all texts without words.
    before, after = steps[2]
    groups = brute_groups([(r.doc_id, r.text) for r in before], 5, 80)
    assert sorted(r.doc_id for r in after) == sorted(i for i, n, c in groups if i == c or n == 0)

    # Mix: whole copies, three at most, and each source near its target.
    before, after = steps[3]
    size, got = {r.doc_id: len(r.text.split()) for r in before}, Counter(r.doc_id for r in after)
    assert max(got.values()) <= 3 and set(got) <= set(size) and all(size[i] for i in got)
    per, taken, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in before:
        per[r.source] += size[r.doc_id]
        taken[r.source] += size[r.doc_id] * got[r.doc_id]
        longest[r.source] = max(longest[r.source], size[r.doc_id])
    for s, target in targets(per).items():
        assert abs(taken[s] - target) <= longest[s]

    # Ids: as the public library gives them.
    before, after = steps[4]
    ranks = bpe.Ranks.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter((r.doc_id, sha(np.array(library.encode_ordinary(r.text), dtype="<u4").tobytes()), sha(r.text.encode())) for r in before)
    assert Counter((r.doc_id, r.ids_sha256, r.decoded_sha256) for r in after) == want

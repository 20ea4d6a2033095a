"""The pipeline's rows against the stages' plain meaning, stage by stage."""

import corpus_pipeline
from tests.llm.test_joins import classes, shingle_set
from tickloom.llm import learning, queries, toxicity
from tickloom.llm.common import table
from tickloom.llm.queries import tokenizer_path
from tickloom.session import materialize

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    from tokenizers import Tokenizer

    docs = table(spark, SF, "documents")
    names = docs.columns
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = rows
    frame = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = materialize(stage(spark, frame, SF), name)
        assert frame.columns == names
        got = {r["doc_id"]: r["text"] for r in frame.collect()}
        if name == "language":
            want = {i for i, t in kept.items() if t and any(map(str.isalpha, t))}
        elif name == "toxicity":
            net = toxicity.train(*learning.labelled_sample(docs, table(spark, SF, "labels"), "toxic", queries.not_held_out(), toxicity.PER_CLASS))
            import pyarrow as pa

            scores = toxicity.score_texts(net, pa.array(list(kept.values())))
            want = {i for i, s in zip(kept, scores) if s < 0.7}
        elif name == "near_duplicates":
            ids = sorted(kept)
            sets = [shingle_set(kept[i], 5) for i in ids]
            root = classes(sets, lambda a, b: a and b and 10 * len(a & b) >= 8 * len(a | b))
            want = {ids[r] for r in root}
        else:
            items = [shingle_set(r["text"], 5) for r in table(spark, SF, "benchmark").collect()]
            want = {i for i, t in kept.items() if not any(q and len(q & shingle_set(t, 5)) >= 0.8 * len(q) - 1e-9 for q in items)}
        assert set(got) == want, name
        kept = got
    library = Tokenizer.from_file(tokenizer_path())
    last = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.STAGES[-1][1](spark, frame, SF).collect()}
    assert last == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in kept.items()}
    whole = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, SF).collect()}
    assert whole == last

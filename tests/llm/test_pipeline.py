import __spark_entry__
import corpus_pipeline
from riskspark.llm.langid import identify_language
from riskspark.llm.quality import score_quality

SF = "/root/testdata/sf0.001"


def test_registered():
    names = list(__spark_entry__.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
    assert len(corpus_pipeline.STAGES) == 4 and corpus_pipeline.ORACLE_SQL is None


def test_stages_keep_what_their_operators_keep(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    (_, language), (_, quality), (_, join), (_, pack) = corpus_pipeline.STAGES
    rows = lambda df: sorted(map(str, df.collect()))
    one = language(spark, docs, SF)
    good = {r.doc_id for r in identify_language(docs).collect() if r.lang_pred != "und" and r.score >= 0.5}
    assert rows(one) == rows(docs.where(docs.doc_id.isin(list(good)))) and one.columns == docs.columns
    two = quality(spark, one, SF)
    good = {r.doc_id for r in score_quality(one, labels).collect() if r.predicted}
    assert rows(two) == rows(one.where(one.doc_id.isin(list(good)))) and two.columns == docs.columns
    three = join(spark, two, SF)
    texts = {r.doc_id: {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} for r in two.collect() if (w := r.text.encode().lower().split())}
    up = {i: i for i in texts}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in texts:
        for j in texts:
            if j < i and 100 * len(texts[i] & texts[j]) >= 80 * len(texts[i] | texts[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    assert sorted(r.doc_id for r in three.collect()) == sorted(i for i in texts if root(i) == i) and three.columns == docs.columns
    four = pack(spark, three, SF)
    assert {r.doc_id for r in four.select("doc_id").distinct().collect()} == {r.doc_id for r in three.collect()}
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "doc_tokens").distinct().collect())) == \
        sorted(map(tuple, four.select("doc_id", "doc_tokens").distinct().collect()))


def test_near_copies_by_five_words_and_four_fifths(spark, words):
    """A copy with a fifth of its words appended (0.83 at 5 words) goes, one with a third
    appended (0.75) stays, as brute force over 5-word shingles says."""
    line = [f"{w}{k}" for k, w in enumerate(words)]
    texts = {1: line[:200], 2: line[:240], 3: line[240:340], 4: line[240:373], 5: line[:198] + ["new"] * 9, 6: line[390:393]}
    sets = {i: {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} for i, w in texts.items()}
    near = [(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    gone = {j for _, j in near}
    assert (1, 2) in near and (3, 4) not in near and 5 in gone
    docs = spark.createDataFrame([(i, " ".join(w), "en", "s", 0) for i, w in texts.items()],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    (_, join) = corpus_pipeline.STAGES[2]
    assert sorted(r.doc_id for r in join(spark, docs, SF).collect()) == sorted(set(texts) - gone)

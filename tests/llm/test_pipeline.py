import corpus_pipeline as P
from llm_rows import ODD, PROSE, by_row
from test_pii import brute as base_spans
from test_quality_rules import brute as quality
from test_simhash import brute as components
from tracewell.llm import decontaminate, pii
import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, small):
    docs = small
    rows = {r.doc_id: r.text for r in small.collect()}
    bench = [(str(r.item_id), r.text.encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    automaton = decontaminate.automaton(bench)
    for (name, stage), then in zip(P.STAGES, [*P.STAGES[1:], None], strict=True):
        out = stage(spark, docs, SF)
        if then:
            assert out.columns == small.columns
        got = {r.doc_id: r.text for r in out.collect()}
        if name == "quality_rules":
            assert set(got) <= set(rows) and all(not quality(rows[d])[0][-1] for d in got)
            assert {d for d in rows if d not in got} >= {d for d, t in rows.items() if quality(t)[0][-1]}
        elif name == "near_dedup":
            assert got == {c: rows[c] for _, _, c in components(list(rows.items()))}
        elif name == "decontamination":
            assert got == {d: t for d, t in rows.items() if not decontaminate.matches(automaton, decontaminate.normalise(t.encode()))[0]}
        elif name == "pii":
            assert set(got) == set(rows) and not any(base_spans(t) for t in got.values())
            assert all(got[d] == t for d, t in rows.items() if not pii.find(t))
        else:
            assert got == rows and all(r.round_trip and r.n_tokens == len(r.ids) for r in out.collect())
        rows, docs = got, spark.createDataFrame(out.select(*small.columns).collect(), small.schema)


def test_run_is_the_stages_in_turn(spark):
    out = P.run(spark, SF)
    assert out.count() > 100 and out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert entry.queries()["pipeline"] is P.run and "pipeline" not in entry.oracle_sql()


def test_odd_rows(spark, odd, none):
    docs, empty = odd, none
    for k, (_, stage) in enumerate(P.STAGES):
        docs, empty = stage(spark, docs, SF), stage(spark, empty, SF)
        if k < len(P.STAGES) - 1:
            assert docs.columns == odd.columns and empty.columns == odd.columns
    good = [d[:2] for d in ODD if d[1] and PROSE[:20] in d[1]]
    assert by_row(docs, "doc_id") == sorted({(c,) for _, _, c in components(good)}) and empty.count() == 0


def test_queries_are_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))

"""What the rounds of the cycle search send through the driver."""

from tidemark.operators import graph as gr


def test_no_round_broadcasts_a_table(spark, monkeypatch):
    plans, plain = [], gr.materialize
    monkeypatch.setattr(gr, "materialize", lambda df, label: plans.append((label, df._jdf.queryExecution().executedPlan().toString())) or plain(df, label))
    rows = [(i, (i * i + 1) % 60) for i in range(60)] + [(i, (i + 7) % 40) for i in range(40)] + [(3, 3), (70, 71), (71, 72), (72, 70), (5, 70)]
    out = gr.find_cycles(spark.createDataFrame(rows, "src long, dst long"))
    plans.append(("out", out._jdf.queryExecution().executedPlan().toString()))
    assert {r["component"] for r in out.collect()} >= {70}
    assert not [label for label, plan in plans if "Broadcast" in plan]

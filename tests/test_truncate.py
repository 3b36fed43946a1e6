from sluice.functions.truncate import GENERIC, PROCUREMENT, Truncator, keyword_profile, truncate


def run(text, budget, profile=PROCUREMENT):
    return dict(zip(("text", "original", "final", "method", "dropped", "windows", "profile"), Truncator(profile, budget).run(text)))


def test_under_budget_unchanged():
    assert run("short", 100) == {"text": "short", "original": 5, "final": 5, "method": "no_op", "dropped": None, "windows": None, "profile": "procurement"}


def test_safe_tail_always_and_early_marker_never():
    body = "word " * 4000
    r = run(body + "BOARD POLICY MANUAL " + "x" * 6000, 10**6)
    assert r["method"] == "trimmed_safe_tail" and r["dropped"] == len(body) and r["text"] == body
    assert run("BOARD POLICY MANUAL " + body, 10**6)["method"] == "no_op"


def test_risky_tail_only_over_budget():
    body = "word " * 4000
    text = body + "APPENDIX A " + "y" * 6000
    assert run(text, 10**6)["method"] == "no_op"
    assert run(text, 21_000)["method"] == "trimmed_tail"


def test_windows_keep_what_stands_at_the_end():
    text = "filler words here. " * 20_000 + "Contract with Acme for $45,000 total" + " more filler." * 500
    r = run(text, 60_000)
    assert r["method"] == "trimmed_tail+windows" and "Acme" in r["text"] and r["windows"] == 1


def test_last_step_sizes():
    p = GENERIC
    for n, want in ((10_000, 10_000), (20_000, 20_000 + 10_003), (35_000, 30_000 + 10_003), (100_000, 40_003)):
        assert run("a" * n, 5_000, p)["final"] == want
    assert run("a" * 100_000, 50_000, p)["final"] == 50_000


def test_order_and_keywords():
    p = keyword_profile(["dosage"], ["References"], window=10, tail_least=5)
    r = run("a" * 50 + " dosage " + "b" * 50 + " dosage " + "c" * 50, 60, p)
    assert r["windows"] == 2 and r["text"].index("a") < r["text"].index("c")
    assert run("x" * 30 + " References " + "y" * 10, 45, p)["method"] == "trimmed_safe_tail"


def test_column(spark):
    df = spark.createDataFrame([("x" * 50,), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(truncate("t", 10, GENERIC.sized(head_chars=4, tail_chars=2, gap="|"))).collect()]
    assert got[0].text == "xxxx|xx|xx" and got[0].final_chars == 10 and got[1] is None and got[2].method == "no_op"

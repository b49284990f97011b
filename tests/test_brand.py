"""Audit of renders against brand contracts in small cases, with nulls, repeated rows and empty tables."""

from tempora.operators import brand as B

TABLES = {
    "edits": "edit_id long, project long", "evidence": "edit_id long, field string, value string", "contracts": "project long, field string, value string",
    "steps": "edit_id long, area string, measure string, amount long, measured boolean", "limits": "edit_id long, measure string, most long",
    "drawn": "edit_id long, cue_idx long, text string, drawn string, line_px long, box_px long, size_px long, asked_px long", "levels": "edit_id long, item string, gain long, after long",
    "segments": "edit_id long, film string, sha string, imported_sha string, size string, font string, made_sha string, near_permille long", "accepted": "edit_id long, rule string",
}


def audit(spark, **rows):
    made = [spark.createDataFrame(rows.get(n, []), schema) for n, schema in TABLES.items()]
    return {(r.edit_id, r.rule, r.ref): r for r in B.brand_audit(*made).collect()}


def verdicts(spark, **rows):
    return {rule: r.passed for (_, rule, _), r in audit(spark, edits=[(1, 7)], **rows).items()}


def test_empty_tables(spark):
    assert audit(spark) == {}
    got = verdicts(spark)  # neither evidence nor contract: nothing is asked for, but a size that isn't known has no ratio
    assert not got.pop("aspect ratio") and all(got.values()) and "caption mode" not in got and "voice not over-processed" not in got


def test_comparisons(spark):
    terms = [(7, f, v) for f, v in [("sha", "a"), ("font_family", "Inter"), ("size", "1080x1920"), ("logo", "required"), ("phrase_mode", "true"), ("background_style", "box"), ("end_style", "both"), ("unheard", "x")]]
    seen = [(1, f, v) for f, v in [("contract_sha", "a"), ("font_family", "inter"), ("size", "540x960"), ("captions_burned", "true"), ("phrase", "true"), ("background_style", "none"), ("ending", "overlay"), ("font_family", None)]]
    got = verdicts(spark, contracts=terms, evidence=seen)
    want = {"brand contract applied": True, "caption font family": False, "resolution": False, "aspect ratio": True, "logo": False, "caption mode": True, "caption background": False, "ending as contracted": False}
    assert {k: got[k] for k in want} == want and "captions in full" not in got
    again = verdicts(spark, contracts=terms * 2, evidence=seen * 2)  # repeated rows count once
    assert again == got


def test_policies_and_ceilings(spark):
    terms = [(7, "audio_policy", "required"), (7, "picture_policy", "auto")]
    left = verdicts(spark, contracts=terms, evidence=[], steps=[(1, "audio", "ratio", 1, True)])
    assert left["audio policy"] and not left["audio left as recorded"] and left["picture left as recorded"]  # "none" may always be recorded, but then nothing is done
    used = [(1, "audio_policy", "required"), (1, "picture_policy", "required"), (1, "audio_measured", "false")]
    steps = [(1, "audio", "ratio", 2000, True), (1, "picture", "gamma", 1300, None), (1, "picture", "unheard", 10**9, True), (1, "picture", "sharpen", None, True), (2, "picture", "gamma", 10**9, True)]
    got = verdicts(spark, contracts=terms, evidence=used, steps=steps)
    assert got["audio policy"] and not got["picture policy"] and not got["required audio repair"] and got["voice not over-processed"]
    assert got["picture not over-processed"] and not got["picture measured"]
    strict = verdicts(spark, contracts=terms, evidence=used, steps=steps, limits=[(1, "gamma", 1299), (1, "gamma", 5000)])
    assert not strict["picture not over-processed"]
    moves = verdicts(spark, contracts=terms, evidence=used, levels=[(1, "x", -600, 0), (1, "y", 600, 151)])
    assert moves["level moves"] and not moves["one speech level"]


def test_layout_from_drawn_cues(spark):
    cues = [
        (("one  two", "one two", 100, 100, 40, 40), [True] * 5),
        (("one two", "one…", 101, 100, 39, 40), [False, False, False, True, False]),
        (("wait...", "wait...", None, None, None, None), [True, True, False, True, True]),
        (("a longer line", None, 1, 2, 40, 40), [False, True, True, False, True]),
        ((None, "", 1, 2, 40, 40), [True] * 5),
        (("w " * 50_000, "w\n" * 50_000, 1, 2, 40, 40), [True, True, True, False, True]),
    ]
    ids = range(len(cues))
    got = audit(spark, edits=[(i, 7) for i in ids], contracts=[(7, "max_chars_per_cue", "9")], evidence=[(i, "captions_burned", "true") for i in ids], drawn=[(i, 0, *cues[i][0]) for i in ids])
    for i in ids:
        rules = ("captions in full", "no added ellipsis", "captions fit the box", "cue length", "caption size")
        assert [got[i, r, None].passed for r in rules] == cues[i][1], cues[i][0][:2]


def test_films_and_accepted_deviations(spark):
    terms = [(7, "title_font", " Lora "), (7, "size", "10x10"), (7, "sha", "s")]
    films = [(1, "good", "h", "h", "10x10", "LORA", "s", 600), (1, "bad", "h", None, "9x9", None, "t", None), (3, "stray", "h", "h", "10x10", "LORA", "s", 600)]
    got = audit(spark, edits=[(1, 7), (1, 7), (2, None)], contracts=terms, segments=films, accepted=[(1, "film font"), (1, "film font"), (2, "film size")])
    of = lambda ref: [got[1, r, ref].passed for r in ("film unchanged", "film size", "film font", "film made under the contract", "film in the brand's colours")]
    assert of("good") == [True] * 5 and of("bad") == [False] * 5
    assert got[1, "film font", "bad"].accepted and got[1, "film font", "bad"].severity == "warning"
    assert not got[1, "film font", "good"].accepted and got[1, "film size", "bad"].severity == "error"
    assert not any(e == 3 for e, _, _ in got) and (2, "resolution", None) in got


def test_wide_tables_and_no_join_behind_the_rules(spark):
    """Evidence and contracts may come as columns, and rows of rules, the most by far, are neither joined nor shuffled."""
    rows = {"edits": [(1, 7), (2, 8)], "accepted": [(1, "resolution")], "levels": [(1, "x", 601, 0)], "evidence": [(1, "size", "9x9"), (1, "audio_policy", "auto")], "contracts": [(7, "size", "1x1")]}
    made = {n: spark.createDataFrame(rows.get(n, []), schema) for n, schema in TABLES.items()}
    wide = made | {
        "evidence": spark.createDataFrame([(1, "9x9", "auto", None)], "edit_id long, size string, audio_policy string, unheard string"),
        "contracts": spark.createDataFrame([(7, "1x1")], "project long, size string"),
    }
    a, b = B.brand_audit(*made.values()), B.brand_audit(*wide.values())
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and any(r.accepted for r in b.collect())
    plan = b._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan[: plan.index("Generate explode")]

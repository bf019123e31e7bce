from tidemark.llm import personal

SEEDS = [
    "联系人赵栩，电话12651251365。", "患者姓名：赵芷岑，证件号990361193910194206，已核对腕带。", "经办人：钱栩芷 邮箱 k_yuan+5(at)example.org；", "昨日钱岑来电询问结果。", "家属赵岑栩留电126 1343 6754，要求告知。",
    "主治医师欧阳芷已向家属交代病情。", "护工欧阳岑代取报告，出示证件ZX5860989。", "王氏评分9分。墨菲征阴性。", "Next of kin is Mirelle Brockmere, reachable on +44 7700 900149 or d_lunetta+4@example.net.",
    "Please call (244) 555-0129 and ask for Tavian Brockmere.", "Identity document 000-57-5589 was shown by Brockmere, Tavian at the desk.", "Mirelle Keldane wrote from X.Y@MAIL.EXAMPLE.ORG to confirm the visit.", "Spoke with Tavian Keldane this morning.",
    "家属在场时，患者诉恶心。", "家属在场时，患者诉乏力。", "家属在场，患者诉低热。", "家属在场，否认不适。",
]
CASES = [
    ("由其女赵栩岑陪同来院，家住霜桥市石湫县长亭东路760号7号楼1979室。", {("name", "赵栩岑"), ("address", "霜桥市石湫县长亭东路760号7号楼1979室")}),
    ("现住址砚池区芦汀镇第2村2组12号，出院后由社区随访。", {("address", "砚池区芦汀镇第2村2组12号")}),
    ("入院登记：钱芷/990238 19430705 435x/(０１９９)5557238；", {("name", "钱芷"), ("id_number", "990238 19430705 435x"), ("phone", "(０１９９)5557238")}),
    ("检验条码621260759982，标本批号08401725，申请单号ZK-1245-115，床号75-8，2029-11-27，王氏评分9分。", set()),
    ("Ms. T. Keldane asked that the report go to 95 Ninewells Avenue, Flat 37, Hollin Bay.", {("name", "T. Keldane"), ("address", "95 Ninewells Avenue, Flat 37, Hollin Bay")}),
    ("The patient now lives at Am Tannensteig 118, 00592 Tannbrück. Frozen Section of Old Films.", {("address", "Am Tannensteig 118, 00592 Tannbrück")}),
    ("no vitamin K. Mirelle Brockmere wrote from a_b+6 at mail.example.org to confirm; 030/23125-168", {("name", "Mirelle Brockmere"), ("email", "a_b+6 at mail.example.org"), ("phone", "030/23125-168")}),
    ("家属在场时，患者诉恶心。", set()), (None, set()), ("", set()), ("赵" * 30_000, set()),
]


def test_find_and_replace(spark):
    lexicon = personal.learn_lexicon(spark.createDataFrame([(t,) for t in [*SEEDS, None, ""]], "text string"))
    assert lexicon["family"] == {"赵", "钱", "欧阳"} and {"栩", "芷", "岑"} <= lexicon["given"] and {"Mirelle", "Brockmere", "Keldane", "Tavian"} <= lexicon["word"]
    assert "场" not in lexicon["given"] or "在" not in lexicon["family"]
    df = spark.createDataFrame([(i, t, "k") for i, (t, _) in enumerate(CASES)], "row_id bigint, text string, kind string")
    found = {(r["row_id"], r["kind"], r["hit"]) for r in personal.find_personal(df, lexicon).collect()}
    assert found == {(i, k, h) for i, (_, hits) in enumerate(CASES) for k, h in hits}
    clean = {r["row_id"]: r["text"] for r in personal.sanitise(df, lexicon).collect()}
    assert clean[0] == "由其女〔NAME〕陪同来院，家住〔ADDRESS〕。" and clean[3] == CASES[3][0]
    assert clean[8] is None and clean[9] == ""
    # nothing is found in what is already clean
    again = spark.createDataFrame([(i, t) for i, t in clean.items()], "row_id bigint, text string")
    assert personal.find_personal(again, lexicon).count() == 0


def test_hot_name(spark):
    # one full name, in a third of all rows: a note copied, and the same person in notes of their own
    plain = [(f"今日第{i}次查房，腹痛减轻。",) for i in range(400)]
    copied, named = [("家属赵栩，电话12651251365。",)] * 100, [(f"今日复查第{i}项，主治医师赵栩，已阅。",) for i in range(140)]
    for hot in (copied, named, copied + named):
        texts = [*SEEDS, *(t for t, in plain + hot)]
        lexicon = personal.learn_lexicon(spark.createDataFrame([(t,) for t in texts], "text string"))
        assert lexicon["family"] == {"赵", "钱", "欧阳"} and {"栩", "芷", "岑"} <= lexicon["given"]
        df = spark.createDataFrame([(0, hot[-1][0]), (1, "护工钱栩代取报告。"), (2, "联系人赵芷岑，")], "row_id bigint, text string")
        assert {(r["row_id"], r["hit"]) for r in personal.find_personal(df, lexicon).where("kind = 'name'").collect()} == {(0, "赵栩"), (1, "钱栩"), (2, "赵芷岑")}


def test_empty(spark):
    none = spark.createDataFrame([], "row_id bigint, text string")
    lexicon = personal.learn_lexicon(none)
    assert personal.name_pattern(lexicon) is None and personal.find_personal(none, lexicon).count() == 0
    plain = spark.createDataFrame([(1, "电话12651251365")], "row_id bigint, text string")
    assert personal.find_personal(plain, lexicon).first()["hit"] == "12651251365"


def test_written_forms():
    for text, kind, hit in (
        ("Lives at 221B Baker St., London NW1 6XE since", "address", "221B Baker St., London NW1 6XE"), ("call 020 7946 0958 now", "phone", "020 7946 0958"), ("tel +33 1 23 45 67 89.", "phone", "+33 1 23 45 67 89"),
        ("Passport: 123456789", "id_number", "123456789"), ("to P.O. Box 112, Leeds", "address", "P.O. Box 112, Leeds"), ("at 10 rue de Rivoli, 75001 Paris.", "address", "10 rue de Rivoli, 75001 Paris"),
        ("mail john.o'neil@example.org", "email", "john.o'neil@example.org"), ("住北京市海淀区中关村路27号院3号楼", "address", "北京市海淀区中关村路27号院3号楼"),
    ):
        assert [(k, text[a:b]) for a, b, k in personal.structured(text)] == [(kind, hit)], text
    for text in ("CA72-4 5.2 U/mL", "Murphy sign 3 St. Marys", "lot 4471-220", "bed 12, room 4"):
        assert personal.structured(text) == [], text


def test_names_that_stand_once(spark):
    plain = [(f"第{i}次查房，患者情况平稳，继续观察。The drain was removed on day {i}.",) for i in range(400)]
    once = ["联系人赵栩，电话已登记。夜间赵栩来访。", "Spoke with Aldous Penhaligon at noon; Aldous Penhaligon agreed.", "家属于昨日，到院。", "联系人未到，明日再问。", "Spoke with Radiology Department at noon."]
    texts = spark.createDataFrame(plain + [(t,) for t in once], "text string")
    lexicon = personal.learn_lexicon(texts)
    pattern = personal.name_pattern(lexicon)
    hits = [[t[a:b] for a, b, _ in personal.spans_of(t, lexicon, pattern)] for t in once]
    assert hits == [["赵栩", "赵栩"], ["Aldous Penhaligon", "Aldous Penhaligon"], [], [], []]
    assert all(personal.spans_of(t, lexicon, pattern) == [] for (t,) in plain)


def test_names_in_unseen_sentences(spark):
    import random

    draw = random.Random(5)
    families, given = "赵钱孙李周吴郑王冯陈", "栩珩屿蓁霁岑荞槐筠漪"
    first, last = ["Aldous", "Elowen", "Tavian", "Corwin", "Maelis", "Quillon"], ["Penhaligon", "Morrowind", "Grunwaldt", "Brockmere", "Harkness", "Penrowe"]
    han = lambda: draw.choice(families) + "".join(draw.sample(given, draw.randint(1, 2)))
    latin = lambda: f"{draw.choice(first)} {draw.choice(last)}"
    learn = [(f"联系人{han()}，电话{i}。",) for i in range(150)] + [(f"Spoke with Dr. {latin()} on day {i}.",) for i in range(150)] + [(f"第{i}次复查，余同前。No change on day {i}.",) for i in range(300)]
    lexicon = personal.learn_lexicon(spark.createDataFrame(learn, "text string"))
    pattern = personal.name_pattern(lexicon)
    wanted = found = 0
    for k in range(200):
        name = han() if k % 2 else latin()
        text = draw.choice(["据{}回忆，当时未见异常。", "此事由{}转告。"] if k % 2 else ["According to {} nothing had changed.", "{} brought the old films."]).format(name)
        hits = [text[a:b] for a, b, _ in personal.spans_of(text, lexicon, pattern)]
        wanted, found = wanted + 1, found + (hits == [name])
    assert found >= 0.9 * wanted

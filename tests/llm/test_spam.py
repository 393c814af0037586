import pytest

from cytora.llm import spam

PROSE = "We saw a clog in the plot of the first tube, and the mean of the cells fell by half. After the wash nothing changed, so the gate was redrawn. Does anyone know why the fit fails when the tubes show doublets? "
SPAM = [
    "best cheap laser cheap laser best online top laser cheap online best top " * 12,
    "cheap cytometer, laser repair, used cytometer, cheap cytometer, sheath fluid, laser repair, " * 8,
    " ".join(f"#tag{i % 9}" for i in range(60)),
    "\n".join(f"[cell sorter {i}](http://shop{i}.example/sorter?id={i})" for i in range(30)),
    "\n".join(f'<a href="http://shop{i}.example/x">laser repair</a>' for i in range(30)),
    "\n".join(f"Anti-CD{i} PE 50 tests only ${i}0 buy now" for i in range(20)),
    " » ".join(["Home", "Shop", "Lasers", "Beads (12)", "Contact", "Cart", "Login"] * 6),
    "flow lab Malvasia: our flow lab is the top flow lab for Malvasia flow lab. Call Hollin flow lab today, flow lab experts, flow lab Hollin. Best flow lab Sarnley, flow lab prices Sarnley. " * 4,
    "\n".join(["laser repair", "used cytometer", "LASER REPAIR"] * 15),
]


@pytest.mark.parametrize("text", SPAM)
def test_spam(text):
    assert spam.spam_share(text) > 0.5
    assert spam.spam_share(text + "\n" + PROSE[:80]) > 0.5


@pytest.mark.parametrize("text", [
    PROSE * 5,
    PROSE * 3 + "\nKeywords: laser, beads, gating\nSee also:\n- https://docs.example/a\n- https://docs.example/b\n" + PROSE * 2,
    PROSE * 2 + "\nCD3\tFITC\tclone A1\t5 µl\nCD4\tPE\tclone A2\t5 µl\nCD8\tAPC\tclone A3\t2 µl\n",
    "Download the guide from https://docs.example/guide5 before you touch the flow cell. " * 3,
    "The price of the kit rose to $90, so the team bought 11 tests. " + PROSE * 2,
    "Der Laser wurde 22 Minuten vor dem ersten Lauf eingeschaltet. Das Tor wurde von Hand verschoben, danach passte der Median. " * 3,
    "short note", "", "\n\n\t", "…", None,
])
def test_no_spam(text):
    assert spam.spam_share(text) <= 0.5


def test_table(spark):
    rows = [(i, t, "x", 0.1) for i, t in enumerate(SPAM)] + [(100, PROSE * 4, "x", 0.1), (101, None, "x", 0.1), (102, "", "x", 0.1), (None, SPAM[0], "x", 0.1), (0, SPAM[0], "x", 0.1), (103, "cheap laser " * 100_000, "x", 0.1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, main_kind string, share double")
    assert sorted(r[0] for r in spam.spam_pages(df).collect()) == [*range(len(SPAM)), 103]
    assert spam.spam_pages(df.limit(0)).count() == 0
    scores = {r["doc_id"]: r for r in spam.page_scores(df).collect()}
    assert scores[3]["n_shapes"] <= 3 and scores[3]["share"] > 0.9 and 101 not in scores


LANGUAGES = [
    "Próbki zostały umyte dwukrotnie w buforze przed barwieniem przeciwciałami. Następnie komórki zostały zawieszone w roztworze i przeniesione do czystych probówek. Wyniki pokazują, że sygnał był słabszy niż w poprzednim tygodniu, dlatego powtórzyliśmy pomiar po wymianie lasera.",
    "Образцы были дважды промыты буфером перед окрашиванием антителами. После этого клетки перенесли в чистые пробирки и оставили на льду до измерения. Результаты показывают, что сигнал оказался слабее, чем на прошлой неделе, поэтому мы повторили измерение после замены лазера.",
    "Näytteet pestiin kahdesti puskurilla ennen värjäystä. Sen jälkeen solut siirrettiin puhtaisiin putkiin ja jätettiin jäihin mittaukseen asti. Tulokset osoittavat, että signaali oli heikompi kuin viime viikolla, joten toistimme mittauksen laserin vaihdon jälkeen.",
    "Örnekler boyamadan önce tamponla iki kez yıkandı. Daha sonra hücreler temiz tüplere aktarıldı ve ölçüme kadar buz üzerinde bekletildi. Sonuçlar sinyalin geçen haftaya göre daha zayıf olduğunu gösteriyor.",
    "A mintákat festés előtt kétszer mostuk pufferrel. Ezután a sejteket tiszta csövekbe tettük, és a mérésig jégen tartottuk. Az eredmények azt mutatják, hogy a jel gyengébb volt, mint a múlt héten.",
    "I campioni sono stati lavati due volte con il tampone prima della colorazione. Poi le cellule sono state trasferite in provette pulite e lasciate in ghiaccio fino alla misura.",
    "Proverna tvättades två gånger med buffert före färgningen. Därefter flyttades cellerna till rena rör och låg på is fram till mätningen.",
    "De monsters werden twee keer gewassen met buffer voor de kleuring. Daarna werden de cellen naar schone buizen overgebracht en tot de meting op ijs bewaard.",
    "我们用缓冲液洗涤样品两次，然后进行染色。之后将细胞转移到干净的试管中，并在冰上保存至测量。结果显示信号比上周弱。",
    "Τα δείγματα πλύθηκαν δύο φορές με ρυθμιστικό διάλυμα πριν από τη χρώση. Στη συνέχεια τα κύτταρα μεταφέρθηκαν σε καθαρούς σωλήνες και έμειναν στον πάγο μέχρι τη μέτρηση.",
]


@pytest.mark.parametrize("text", LANGUAGES)
def test_prose_of_other_languages(text):
    assert spam.spam_share(text) <= 0.5
    assert spam.spam_share(text.replace(". ", ".\n")) <= 0.5
    assert spam.spam_share(text.upper()) <= 0.5


def test_lists_of_single_keywords_in_any_layout():
    words = [f"{a} {b}{c}" for a in ("cheap", "used", "best", "flow", "mass") for b in ("cytometer", "antibody", "laser", "beads", "reagent", "software", "sorter", "repair") for c in (" online", " shop", "", " sale", " kit")]
    words = [words[(37 * i) % 200] for i in range(200)]
    for text in (". ".join(w.capitalize() for w in words) + ".", "\n".join(words), ", ".join(words), " ".join(words), " | ".join(words)):
        assert spam.spam_share(text) > 0.5


def test_the_crawl_tells_where_a_page_holds_little(spark):
    line = "Remember: spectral unmixing comes before embedding"
    prose = [(i, f"It was not so on day {i} of the run, and we had to go on as before\nwith all of it in the end") for i in range(50)]
    share = lambda rows: {r["doc_id"]: r["share"] for r in spam.page_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert share([(1000, line)])[1000] > 0.5  # of its own shape the crawl knows nothing but this line
    similar = [(i, "It was so on day 3") for i in range(50)]
    lists = [(i, "Cell sorter kits parts 7 beads") for i in range(50)]
    text = "Cell sorter parts lab 7 kits"
    assert share([(1000, text), *similar])[1000] < 0.5 < share([(1000, text), *lists])[1000]
    assert max(share(prose).values()) <= 0.5

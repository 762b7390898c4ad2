import random

from tablewright.llm import encoding as E

SENTENCES = [
    "La température de l’étang a été relevée à 15 °C près de la forêt.", "Où la clôture était brisée, la parcelle a été exclue.", "Die Größe der Fläche wurde jährlich überprüft.", "Für Mäuse fehlen Messwerte über 5 µg/L.", "El tamaño de la parcela cambió el último año.",
    "Se pesó cada pájaro después de la lluvia.", "A estação da manhã não registou variação.", "Três irmãs anotaram a pesagem da maçã.", "Każda próba została zważona ponownie, łącznie sześć sztuk.", "Źródło wody leży powyżej łąki.", "Данные проверены дважды.", "Пробы взяты весной у деревни.",
    "Οι μετρήσεις έγιναν την άνοιξη.", "Το δείγμα χάθηκε στη διαδρομή.", "Note: naïve plot, 10 µm mesh and ½ ration.", "The crew’s notes say “no change” – twice.",
]


def _texts(n=250):
    draw = random.Random(3)
    return [f"{draw.choice(SENTENCES)} {draw.choice(SENTENCES)}" for _ in range(n)]


def test_lossy_chains_are_named_but_not_undone():
    model = E.train(_texts())
    named = 0
    for s in SENTENCES:
        lost = E.garble(s, "cp1252>utf-8 lossy")
        if lost and "\ufffd" in lost:
            damaged, chain, restored = model.judge(f"{lost} {lost}")
            assert damaged and restored is None
            named += chain in E.LOSSY
    assert named >= 6


def test_many_texts_at_once_as_one_by_one(monkeypatch):
    model = E.train(_texts())
    texts = [E.garble(s, c) or s for s in SENTENCES for c in list(E.CHAINS)[:12]] + [None, "", "plain", "caf\ufffd", *SENTENCES]
    alone = [model.judge(t) for t in texts]
    for size in (1, 700, 10**6):
        monkeypatch.setattr(E, "CHUNK", size)
        assert model.judge_all(texts) == alone


def test_training_takes_texts_of_any_length(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(E, "train", lambda texts: seen.extend(texts))
    long = " ".join(SENTENCES[i % len(SENTENCES)] + f" № {i}." for i in range(3000))
    E.fit(spark.createDataFrame([(1, long), (2, SENTENCES[0]), (3, "plain"), (4, None)], "decode_id long, text string"))
    assert sorted(map(len, seen))[0] <= len(SENTENCES[0]) and len(seen) == 2 and len(E.sentences(max(seen, key=len))) <= E.TEXT_SENTENCES + 1


def test_every_chain_inverts_exactly():
    for chain in E.CHAINS:
        for s in SENTENCES:
            g = E.garble(s, chain)
            if g is not None and "�" not in g:
                assert E.restore(g, chain) == s, (chain, s)


def test_held_out_accuracy():
    draw = random.Random(4)
    model = E.train(_texts())
    wrong = clean_flagged = n = 0
    for s in SENTENCES:
        clean_flagged += model.judge(s)[0]
        for chain in ("utf-8>cp1252", "utf-8>latin-1", "utf-8>mac_roman", "utf-8>cp437", "mac_roman>latin-1", "cp1251>cp1252", "cp1252>mac_roman", "utf-8>cp1252 twice"):
            g = E.garble(s, chain)
            if g and g != s:
                n += 1
                other = draw.choice(SENTENCES)
                damaged, _, restored = model.judge(f"{other} {g}")
                wrong += not damaged
    assert clean_flagged == 0 and wrong <= 0.05 * n


def test_edges(spark):
    rows = [(1, None, 1), (2, "", 1), (3, "plain", 1), (4, "caf�", 1), (5, "na\x95ve", 1), (6, "Voilà l’été déjà. " * 3000 + "VoilÃ\xa0 lâ€™Ã©tÃ© dÃ©jÃ\xa0.", 1), (6, "Voilà l’été déjà. " * 3000 + "VoilÃ\xa0 lâ€™Ã©tÃ© dÃ©jÃ\xa0.", 1), (7, "Voilà l’été déjà.", 1)]
    df = spark.createDataFrame(rows, "decode_id long, text string, chain int")
    assert sorted(r.decode_id for r in E.found(df).collect()) == [4, 5, 6]
    assert E.found(df.limit(0)).collect() == []

from histrata.llm import mojibake as M

CLEAN = ["Prüfung der Größe", "später geöffnet", "déjà vu côté", "после проверки", "история изменений", "każdą zależność", "設定の優先順を修正"]


def garble(text, right, wrong):
    return text.encode(right, "ignore").decode(wrong, "replace")


def test_bytes_round_trip():
    for name in M.SINGLE:
        every = "".join(M.CHARS[name][b] for b in range(128, 256))
        assert M.to_bytes(every, name) is not None and M.read(M.to_bytes(every, name), name) == every


def test_strict_readings():
    for text in ("é", "Größe", "…", "日本", "Привет"):
        run = "".join(c for c in text if c > "\x7f")
        for wrong in ("cp1251", "mac_roman", "cp437"):
            bad = "".join(M.CHARS[wrong][b] for b in run.encode())
            assert M.strictly(bad)[0] == run
    twice = "".join(M.CHARS["cp1252"][b] for b in "".join(M.CHARS["cp1252"][b] for b in "é".encode()).encode())
    assert M.strictly(twice)[0] == "é"
    for text in ("é", "Ä", "попыток", "рад", "日本語", "“Ã©”", "‘â€™’", "├──", "€", "ATENÇÃO", "Ñandú"):
        assert M.strictly(text) is None, text


def test_alignment():
    assert M.aligned("PrÃ¼fÃ¼ng", "Prüfüng") == [("Ã¼", "ü"), ("Ã¼", "ü")]
    assert M.aligned("Pr�f", "Prüf") == [("�", "ü")] and M.aligned("aéb", "ab") == []
    assert "utf_8>cp1252" in M.pairs_for("Ã¼", "ü") and "koi8_r>cp1251" in M.pairs_for("РПРЩФПЛ", "попыток")


def test_found_and_restored(spark):
    rows = [(f"c{i}_{k}", t) for i, t in enumerate(CLEAN) for k in range(12)]
    bad = {"b1": ("Pr" + "Ã¼" + "fung der Größe", "Prüfung der Größe"), "b2": ("sp�ter geöffnet", "später geöffnet"), "b3": (garble("после проверки", "koi8_r", "cp1251"), "после проверки"), "b4": (garble("после проверки", "cp1251", "latin-1"), "после проверки"), "b5": (garble("история изменений", "koi8_r", "cp1251"), "история изменений"), "b6": ("ka¿d± zale¿no¶æ", "każdą zależność"), "b7": ("100 â‚¬", "100 €"), "b8": (garble("設定の優先順を修正", "euc_jp", "latin-1"), "設定の優先順を修正"), "b9": ("x\x85y", None)}
    fine = {"f1": "Explain why “Ã©” is shown for é", "f2": "drawn with ├── and └──", "f3": "plain", "f4": None, "f5": "Docs: a Â before £", "f6": "`Ã©` is meant", "f7": ""}
    rows += [(k, v[0]) for k, v in bad.items()] + list(fine.items()) + [(None, "Ã©"), ("b1", bad["b1"][0])]
    df = spark.createDataFrame(rows, "oid string, message string").selectExpr("*", "'x' as token")
    got = {r["oid"] for r in M.damaged(df).collect()}
    assert got == set(bad)
    back = {r["oid"]: (r["restored"], r["complete"]) for r in M.restored(df).collect()}
    assert set(back) == set(bad)
    for k, (_, want) in bad.items():
        if want:
            assert back[k][0] == want, k
    assert not back["b9"][1]
    assert M.damaged(df.where("false")).count() == 0


RUSSIAN = "проверки после проверка история историей изменений изменения изменил перед передача передать память памяти запись записи записать старый старая старого новая нового новый очередь очереди сервер серверов страница страницы карта карты ошибка ошибки теперь первый первая сегодня сначала".split()


def _corpus(skew):
    rows = [(f"w{i}_{k}", f"слово {w} тут") for i, w in enumerate(RUSSIAN) for k in range(4)]
    for i, w in enumerate(("проверки", "история", "изменений")):
        rows += [(f"v{i}_{k}", garble(w, "koi8_r", "cp1251")) for k in range(skew)]
    return rows


def test_learned_pairs_reach_words_without_twins(spark):
    """Names that occur nowhere else are restored by voted pairs; so is a phrase whose damaged copy is as frequent as the clean one."""
    rare = ["истопамяти", "старочередь"]
    for skew in (1, 4):
        rows = _corpus(skew) + [(f"r{i}", f"by {garble(w, 'koi8_r', 'cp1251')} today") for i, w in enumerate(rare)]
        rows += [("fine", "истопередача"), ("fine2", "déjà vu"), ("fine3", "Größe")]
        df = spark.createDataFrame(rows, "oid string, message string")
        back = {r["oid"]: (r["restored"], r["complete"]) for r in M.restored(df).collect()}
        assert set(back) == {o for o, _ in rows if o[0] in "vr"}, skew
        assert back["r0"] == ("by истопамяти today", True) and back["v0_0"] == ("проверки", True)


def test_every_word_of_a_token_is_restored(spark):
    rows = _corpus(1) + [("two", "/".join(garble(w, "koi8_r", "cp1251") for w in ("проверки", "история"))), ("half", garble("проверки", "koi8_r", "cp1251") + "/x\x85y")]
    back = {r["oid"]: (r["restored"], r["complete"]) for r in M.restored(spark.createDataFrame(rows, "oid string, message string")).collect()}
    assert back["two"] == ("проверки/история", True) and back["half"] == ("проверки/x\x85y", False)


def test_scripts_and_emoji():
    from histrata.llm import mojibake as M

    for text in ("😀", "🚀🚀", "مرحبا", "สวัสดี", "שלום", "नमस्ते", "👩‍💻"):
        for wrong in ("cp1252", "cp1251", "cp437"):
            run = M.read(text.encode(), wrong)
            assert M.direct(run) and M.direct(run)[1] == text, (text, wrong)
        assert M.direct(text.encode().decode("latin-1"))[1] == text
        assert M.direct(text) is None
    assert M.direct("ШЁ") is None and M.direct("Шёл") is None


def test_tokens_are_replaced_whole(spark):
    """A damaged token inside a longer one is no occurrence of it."""
    from histrata.llm import mojibake as M

    rows = [("a", "ÃƒÂ¼ber Ã¼ xÃ¼x Ã¼"), ("b", "plain"), ("c", "😀 fine"), ("d", "ðŸ˜€ garbled")]
    got = {r["oid"]: r for r in M.restored(spark.createDataFrame(rows, "oid string, message string")).collect()}
    assert set(got) == {"a", "d"} and got["a"]["restored"] == "über ü xüx ü" and got["d"]["restored"] == "😀 garbled" and got["d"]["steps"] == ["strict"]

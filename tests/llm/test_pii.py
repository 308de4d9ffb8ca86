import pytest

from lexiweave.llm.pii import find, identity_card_ok, luhn_ok, mod97_ok, nip_ok, passages, personal_information, pesel_ok

CASES = [
    ("Pisz na jan.nowak+x@poczta.example.", [("email", "jan.nowak+x@poczta.example")]),
    ("adres jnowak[at]poczta (kropka) test do końca", [("email", "jnowak[at]poczta (kropka) test")]),
    ("an anke+wiki @ a.biuro.example senden", [("email", "anke+wiki @ a.biuro.example")]),
    ("* e-mail <nowiki>EWA_X@A.TEST</nowiki>", [("email", "EWA_X@A.TEST")]),
    ("@zarozon (znacznik) http://www.x.example/w?id=5615107&x=@831", []),
    ("tel. +48 119 962 954,", [("phone", "+48 119 962 954")]),
    ("kom.: (+48) 409923926 (tylko SMS)", [("phone", "(+48) 409923926")]),
    ("Dzwonić pod numer (20) 954 55 07 po południu.", [("phone", "(20) 954 55 07")]),
    ("Call (01632) 960 088 or 01632 960388. Tel. 0049 (0)30 23125-403, Anruf unter 030/23125692", [("phone", "(01632) 960 088"), ("phone", "01632 960388"), ("phone", "0049 (0)30 23125-403"), ("phone", "030/23125692")]),
    ("dowód/NIP: 000-903-03-33, tel. (30) 980 70 73. tel. 309-087-838 16-03-1965", [("id_number", "000-903-03-33"), ("phone", "(30) 980 70 73"), ("phone", "309-087-838")]),
    ("tel. 309 087 838 16-03-1965 kom. (20) 983 19 52 12-12-1912", [("phone", "309 087 838"), ("phone", "(20) 983 19 52")]),
    ("9 120 508 m³, 12-10-1946, nr inw. 39651771350, ISBN 978-83-0000-446-0, wersja 7.18.755.3", []),
    ("PESEL 90721574140", [("id_number", "90721574140")]),
    ("Numer ewidencyjny osoby to 277028 38177.", [("id_number", "277028 38177")]),
    ("dowód/NIP: 000-903-03-33; ZZE 845158", [("id_number", "000-903-03-33"), ("id_number", "ZZE 845158")]),
    ("ID no. 666-06-4157. Ausweis ZZ 361 5667 – Identity document: ZZ645348Z.", [("id_number", "666-06-4157"), ("id_number", "ZZ 361 5667"), ("id_number", "ZZ645348Z")]),
    ("Mieszka pod adresem pl. Polna 57, 00-082 Kronydra.", [("address", "pl. Polna 57, 00-082 Kronydra")]),
    ("Przesyłki: al. Zielona 46 m. 10. Pisz", [("address", "al. Zielona 46 m. 10")]),
    ("Odbiór książek: ulica Cicha 80b, Brewlyklir –\nOdbiór: ul. Polna 93, Pisz na", [("address", "ulica Cicha 80b, Brewlyklir"), ("address", "ul. Polna 93")]),
    ("Lives at Apt 6B, 11 Quarry Street. Wohnt in Lindenweg 9, 00906 Brygomał.", [("address", "Apt 6B, 11 Quarry Street"), ("address", "Lindenweg 9, 00906 Brygomał")]),
    ("ulica Źródlana (Czusochin)", []),
    ("ulica Cicha 8b, Łogluto –<ref>x</ref> ulica Cicha 8b, Jazdymera nr inw. 97631252054 ulica Cicha 8, Dzwonić pod", [("address", "ulica Cicha 8b, Łogluto"), ("address", "ulica Cicha 8b, Jazdymera"), ("address", "ulica Cicha 8")]),
    ("* Tomasz Mrikrulak-Truwawska – opiekun strony", [("name", "Tomasz Mrikrulak-Truwawska")]),
    ("udzielił(a) '''CELINA ŚWYGRYLAK'''.", [("name", "CELINA ŚWYGRYLAK")]),
    ("Zdjęcie nadesłał(a) P. Wryhowski. Signed: Bokiworth, Grace", [("name", "P. Wryhowski"), ("name", "Bokiworth, Grace")]),
    ("Unterschrift: Dieter Heike Grodrohofer, Anschrift: Lindenstraße 106.", [("name", "Dieter Heike Grodrohofer"), ("address", "Lindenstraße 106")]),
    ("Według opracowania Zipiplyra nowy puchar rozwija Spór o Bozdadrył.", []),
    ("Hasło opracowane przez: Ł. Heprywicz Adres do korespondencji: os. Polna 1/2", [("name", "Ł. Heprywicz"), ("address", "os. Polna 1/2")]),
]


PLAIN = [
    ("Prosimy o kontakt: tel. 601234567.", [("phone", "601234567")]),
    ("NIP 5260001246 oraz nr inw. 5260001246", [("id_number", "5260001246")]),
    ("NIP: 5260001247", [("id_number", "5260001247")]),
    ("Urodzony w Kielcach, 44051401359, zamieszkały tamże", [("id_number", "44051401359")]),
    ("nakład 601234567 i 5260001246, 44051401358, ISBN 44051401359", []),
]


@pytest.mark.parametrize("text, want", CASES)
def test_find(text, want):
    assert [(k, text[a:b]) for a, b, k, _ in find(text)] == want


@pytest.mark.parametrize("text, want", PLAIN)
def test_plain_digits(text, want):
    assert [(k, text[a:b]) for a, b, k, _ in find(text)] == want


UNLABELLED = [
    ("Wczoraj Jan Nowak spotkał się z kolegą, a potem Anna Mazur wyjechała.", ["Jan Nowak", "Anna Mazur"]),
    ("The house belonged to Paul Smith until 1990.", ["Paul Smith"]),
    ("Rozmawiał z nim J. Kowalski oraz A. B. Mazur.", ["J. Kowalski", "A. B. Mazur"]),
    ("Pomagał mu Kowalski J. w pracy.", ["Kowalski J."]),
    ("Wczoraj Jan poszedł do domu.", []),
    ("Zawiera witaminę C. Następnie grupa B. Wyniki, ul. J. Słowackiego.", []),
    ("Charles University and George Street", []),
]


#: None of these given names, and few of these surname endings, are listed.
BY_CONTEXT = [
    ("Marek Hłasko był pisarzem", ["Marek Hłasko"]),
    ("Jan Kowal mieszka tu", ["Jan Kowal"]),
    ("Napisał Jan Zając.", ["Jan Zając"]),
    ("To M. Hłasko", ["M. Hłasko"]),
    ("Autor: Bronisława Nowakowska", ["Bronisława Nowakowska"]),
    ("Signed: Fatima Haddad", ["Fatima Haddad"]),
    ("Napisała to Ołena Szewczenko w Kijowie.", ["Ołena Szewczenko"]),
    ("Rozmowa z Fatimą Haddad trwała.", ["Fatimą Haddad"]),
    ("Spotkał go Bronisław Malinowski.", ["Bronisław Malinowski"]),
    ("He met Priya Natarajan yesterday. Kwame Mensah wrote so.", ["Priya Natarajan", "Kwame Mensah"]),
    ("Die Autorin Ayşe Yılmaz schrieb das, und Frau Nguyen Thi kam.", ["Ayşe Yılmaz", "Nguyen Thi"]),
    ("Wizyta: George Washington przybył.", ["George Washington"]),  # whoever bears the name
    ("The monument of George Washington, Washington University, pomnik Jana Kilińskiego", []),
    ("W Nowym Sączu stoi Zamek Królewski. Rynek Główny mieści Muzeum Narodowe.", []),
    ("Wielki Tydzień mówi o tym, a Zielona Góra pisze o sobie.", ["Wielki Tydzień"]),  # shape and verb speak for a person, wrongly
    ("BADACZE NAPISALI: PAN WYPRZEDZA LICZBA", []),
]


@pytest.mark.parametrize("text, want", BY_CONTEXT)
def test_names_by_shape_and_context(text, want):
    assert [text[a:b] for a, b, k, _ in find(text) if k == "name"] == want


def test_further_forms():
    for text, want in [
        ("Adres: Rynek Główny 5, 31-042 Kraków.", [("address", "Rynek Główny 5, 31-042 Kraków")]),
        ("Hauptmarkt 3, 90403 Nürnberg", [("address", "Hauptmarkt 3, 90403 Nürnberg")]),
        ("dzwoń +33 6 12 34 56 78.", [("phone", "+33 6 12 34 56 78")]),
        ("card 4111 1111 1111 1112", [("id_number", "4111 1111 1111 1112")]),
        ("zapis 4111 1111 1111 1112 tamże", []),
        ("zapis 4111 1111 1111 1111 tamże", [("id_number", "4111 1111 1111 1111")]),
        ("konto PL61109010140000071219812875", [("id_number", "PL61109010140000071219812875")]),
    ]:
        assert [(k, text[a:b]) for a, b, k, _ in find(text)] == want, text


def test_passages_and_redaction_agree(spark):
    texts = [t for t, _ in [*CASES, *PLAIN, *UNLABELLED, *BY_CONTEXT]] + [f"Adres: {a}." for a in ADDRESSES] + ["zwykłe zdanie o niczym", "", None]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    one = {(r.i, r.kind, r.passage) for r in passages(d, "i", "text").collect()}
    assert one == {(r.i, x.kind, x.passage) for r in personal_information(d, "i", "text").collect() for x in r.found}
    assert one == {(i, k, t[a:b]) for i, t in enumerate(texts) if t for a, b, k, _ in find(t)}
    assert passages(d.limit(0), "i", "text").count() == 0


@pytest.mark.parametrize("text, want", UNLABELLED)
def test_names_without_label(text, want):
    assert [text[a:b] for a, b, k, _ in find(text) if k == "name"] == want


ADDRESSES = [
    "ul. Polna 5, 33-300 Nowy Sącz", "ul. Polna 5, 65-001 Zielona Góra", "ul. Polna 5, 43-300 Bielsko-Biała", "ul. Polna 5, 05-100 Nowy Dwór Mazowiecki",
    "ul. Marii Skłodowskiej-Curie 5", "ul. ks. Jerzego Popiełuszki 4", "ul. św. Jana Pawła II 12", "al. gen. Władysława Andersa 7, 00-201 Warszawa", "ul. 11 Listopada 3, 97-300 Piotrków Trybunalski",
    "ul. Polna 5, Nowy Sącz", "Lindenweg 9, 60311 Frankfurt am Main", "11 Quarry Street, Milton Keynes, MK9 3XX",
]


@pytest.mark.parametrize("address", ADDRESSES)
def test_long_towns_and_streets(address):
    for after in (".", ", tel. +48 119 962 954", "\nPisz", " (dom)"):
        x = f"Adres: {address}{after}"
        assert [(k, x[a:b]) for a, b, k, _ in find(x) if k != "phone"] == [("address", address)]


def test_a_town_ends_before_a_sentence():
    for after in (" Pisz na adres", " oraz dom", " Sekretariat odbiera"):
        x = f"ul. Polna 5, 33-300 Nowy Sącz{after}"
        assert [x[a:b] for a, b, _, _ in find(x)] == ["ul. Polna 5, 33-300 Nowy Sącz"]


def test_validators():
    assert pesel_ok("44051401359") and not pesel_ok("44051401358") and not pesel_ok("1")
    assert nip_ok("123-456-32-18") and not nip_ok("123-456-32-19")
    assert identity_card_ok("ABA300000") and not identity_card_ok("ABA300001")
    assert luhn_ok("4111 1111 1111 1111") and not luhn_ok("4111 1111 1111 1112")
    assert mod97_ok("GB82 WEST 1234 5698 7654 32") and not mod97_ok("GB83 WEST 1234 5698 7654 32")


def test_operator(spark):
    long_text = "Zdanie bez niczego. " * 20_000 + "tel. +48 119 962 954, koniec"
    rows = [(1, "Pisz na a@b.example, tel. +48 119 962 954."), (1, "Pisz na a@b.example, tel. +48 119 962 954."), (2, None), (3, ""), (4, long_text), (None, "x")]
    d = spark.createDataFrame([(*r, 0) for r in rows], "doc_id bigint, text string, found int")
    got = personal_information(d, "doc_id", "text").collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 6 and by[1].redacted == "Pisz na [EMAIL], tel. [PHONE]." and [x.kind for x in by[1].found] == ["email", "phone"]
    assert by[2].redacted is None and by[2].found == [] and by[3].redacted == "" and by[4].redacted.endswith("tel. [PHONE], koniec") and by[None].redacted == "x"
    assert personal_information(d.limit(0), "doc_id", "text").count() == 0

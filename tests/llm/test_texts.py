from collections import Counter

import pytest
import tiktoken
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import answer_pairs as A
from graphloom.llm import mixture as M
from graphloom.llm import spam_pages as P
from graphloom.llm import tokens as T

V = T.public_vocabulary()


@pytest.fixture(scope="module")
def enc():
    import public_tokenizers

    return T.Codec(T.read_ranks(V[0]), V[1]), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=T.read_ranks(V[0]), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=80))
def test_ids_equal_an_independent_encoder_and_decode_back(enc, text):
    ids = enc[0].encode(text)
    assert ids == enc[1].encode_ordinary(text) and enc[0].decode(ids) == text


def test_special_and_long_texts(enc):
    for text in ["<|endoftext|> x", "<unk>", "▁a", "\x00\n\r\t", "a" * 20_000, " " * 5_000, "đ" * 3_000, "日本" * 2_000, "".join(map(chr, range(1, 3_000)))]:
        assert enc[0].encode(text) == enc[1].encode_ordinary(text)
    with pytest.raises(ValueError):
        T.serialise({b"a": 0, b"b": 2})


def test_lengths_in_one_pass(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "Việt Nam <|endoftext|>"), (4, "\x00\n")], "doc_id long, text string").selectExpr("*", "1 as n_tokens", "2 as ids")
    got = {r.doc_id: (r.n_tokens, r.round_trip) for r in T.round_trips(docs, *V).collect()}
    assert got[1] == got[2] == (0, True) and all(ok for _, ok in got.values())
    assert {k: n for k, (n, _) in got.items()} == {r.doc_id: len(r.ids) for r in T.encode_corpus(docs, *V).collect()}
    assert T.round_trips(docs.limit(0), *V).count() == 0


def test_corpus(spark, data):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " "), (4, "Việt Nam"), (4, "Việt Nam")], "doc_id long, text string").selectExpr("*", "1 as ids", "'x' as TEXT2")
    got = rows(T.encode_corpus(docs, *V))
    assert got[:2] == [(1, []), (2, [])] and got[3] == got[4] and got[2][1]
    assert rows(T.decode_corpus(T.encode_corpus(docs, *V), *V))[3:] == [(4, "Việt Nam")] * 2
    assert T.encode_corpus(docs.limit(0), *V).count() == 0
    assert [r.n_tokens for r in T.count_tokens(docs, *V, ["doc_id"]).orderBy("doc_id").collect()][:2] == [0, 0]
    whole = spark.read.parquet(f"{data}/documents.parquet")
    back = T.decode_corpus(T.encode_corpus(whole, *V), *V).withColumnRenamed("text", "b").join(whole, "doc_id")
    assert back.filter("b = coalesce(text, '')").count() == whole.count()


def test_rates_meet_shares_within_caps():
    r = M.rates({"a": 1000, "b": 100}, [("a", 0.5, 2), ("b", 0.3, 3), ("c", 0.2, 9)])
    assert set(r) == {"a", "b"} and abs(r["b"] - 3) < 1e-9 and abs(r["a"] * 1000 / (r["b"] * 100) - 5 / 3) < 1e-9
    assert M.rates({}, [("a", 1.0, 1)]) == {} and M.rates({"a": 5}, [("a", 1.0, 0)]) == {}
    assert M.rates({"a": 100}, [("a", 1.0, 2)], total_tokens=1000) == {"a": 2.0}


def test_mixture(spark):
    docs = [(i, "big" if i % 3 else "small", f"text number {i} " + "word " * (i % 17)) for i in range(600)] + [(1000, "big", "text number 1 word "), (1001, "small", None), (1002, None, "x y"), (1003, "odd", "x y z"), (1004, "small", "")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").selectExpr("*", "1 as n_tokens", "2 as copy_no")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 3), ("gone", 0.2, 2)], "source string, target_share double, max_repeats int")
    mix = M.mix_sources(df, targets, *V)
    copies = mix.copies.collect()
    shares = {r.source: r for r in mix.shares.collect()}
    assert abs(shares["big"].reached_share - 0.5) < 0.02 and abs(shares["small"].reached_share - 0.5) < 0.02 and shares["gone"].tokens_used == 0
    uses = Counter(r.doc_id for r in copies)
    source = {d: s for d, s, _ in docs}
    assert all(n <= {"big": 1, "small": 3}[source[d]] for d, n in uses.items()) and not {1001, 1002, 1003, 1004} & set(uses)
    assert not (1 in uses and 1000 in uses) or dict((d, t) for d, _, t in docs)[1] != dict((d, t) for d, _, t in docs)[1000]
    assert sum(r.n_tokens for r in copies if r.source == "big") == shares["big"].tokens_used
    assert any(r.at_cap for r in shares.values()) and not shares["gone"].at_cap
    assert rows(mix.copies) == rows(M.mix_sources(df.repartition(7), targets, *V).copies)  # the draw doesn't depend on the layout
    empty = M.mix_sources(df.limit(0), targets, *V)
    assert empty.copies.count() == 0 and empty.shares.count() == 3
    assert M.mix_sources(df, targets.limit(0), *V).copies.count() == 0


Q = "Môn KTPM1234 học ở kỳ mấy và bao nhiêu tiết?"
ANSWERS = [
    (Q, None, ["empty"]), (Q, " \u200b ", ["empty"]), (Q, "<p></p>", ["empty"]), (Q, "Trả lời:", ["empty"]), (Q, "N/A", ["empty"]), (Q, "[]", ["empty"]),
    (Q, Q, ["copy"]), (Q, f"Bạn hỏi: {Q}", ["copy"]), (Q, f"{Q} {Q}", ["copy"]), (Q, "mon ktpm1234 hoc o ky may va bao nhieu tiet?", ["copy"]), (Q, f"Câu hỏi của bạn là: {Q} Đó chính là điều bạn muốn biết.", ["copy"]),
    (Q, "Xin lỗi, tôi không thể trả lời câu hỏi này.", ["refusal"]), (Q, "Dạ, mình chưa biết gì về việc này ạ.", ["refusal"]), (Q, "Rất tiếc, ngữ cảnh không có thông tin về ngữ liệu song ngữ.", ["refusal"]), (Q, "I'm sorry, but I can't help with that request.", ["refusal", "other_language"]),
    (Q, "It is offered in semester 3, and the lecturer is appointed each year.", ["other_language"]), (Q, "Das Fach Cơ sở dữ liệu wird im 5. Semester angeboten.", ["other_language"]), (Q, "Cơ sở dữ liệuは5学期に開講されます。", ["other_language"]), (Q, "이 과목은 실습을 중심으로 진행됩니다.", ["other_language"]),
    ("Who teaches Advanced biology?", "Mon hoc nay day ve do thi tri thuc va cuoi ky co do an nhom.", ["other_language"]),
    (Q, "Môn này học ở học kỳ 7. Điểm quá trình chiếm 53% và được tính từ bài", ["truncated"]), (Q, "Môn này học ở học kỳ 7, trong đó một phần ba là thực hành (gồm", ["truncated"]), (Q, "Gồm hai phần. Bên cạnh đó, các", ["truncated"]), (Q, "Các kỹ năng gồm: 1. Một\n2. Hai\n3.", ["truncated"]), (Q, "Môn này được dùng để ...", ["truncated"]),
    (Q, 'Theo giảng viên: "dữ liệu là nền', ["truncated"]), (Q, "Môn A rèn 3 kỹ năng: đọc; viết", ["truncated"]),
    (Q, "Kỳ 2, 65 tiết", []), (Q, "KTPM1234: học kỳ 3", []), (Q, "Xin lỗi vì câu trả lời trước bị nhầm: được, vì môn này không có môn tiên quyết.", []), (Q, "Không. Sinh viên không thể đăng ký nếu chưa đạt điểm D ở học phần về toán.", []), (Q, "Tài liệu không nêu đủ, nhưng chắc chắn có Rust và Figma.", []),
    (Q, f'Về câu hỏi "{Q}": Kỳ 2, 65 tiết', []), ("Ai dạy môn Toán?", "Tăng Uyên Liên Lành", []), ("Who teaches it?", "It is taught by Tăng Uyên Liên Lành, together with a guest.", []), (Q, "Ngoài ra còn có tư vấn, nghiên cứu, v.v...", []), (Q, "- Java\n- Rust\n- C++", []), (None, "Kỳ 2.", []), ("Trinh?", "Trinh Khanh Dong Nghi Do", []),
]


def test_defects(spark):
    df = spark.createDataFrame([(i, q, a) for i, (q, a, _) in enumerate(ANSWERS)], "id long, q string, a string").selectExpr("*", "1 as state", "2 as row_key", "3 as DEFECTS")
    got = {r.row_key: r.defects for r in A.defects([(df, "t", "id", "q", "a")]).collect()}
    assert {i: sorted(got[i]) for i in got} == {i: sorted(d) for i, (_, _, d) in enumerate(ANSWERS)}
    first = {r.row_key: r.defect for r in A.first_defect(A.defects([(df, "t", "id", "q", "a")])).collect()}
    assert first == {i: d[0] for i, (_, _, d) in enumerate(ANSWERS) if d}
    assert A.defects([(df.limit(0), "t", "id", "q", "a")]).count() == 0


def test_languages_and_refusals_beyond_the_usual_ones():
    asked = "Who teaches the course and when is it offered?"
    for answer in ("Kurs jest prowadzony przez dział informatyki oraz kończy się egzaminem, który jest pisemny.", "Het vak wordt door de faculteit gegeven en het eindigt niet met een toets.", "Die Vorlesung wird von der Fakultät angeboten und endet mit einer Prüfung.", "Mata kuliah yang wajib ini adalah untuk mahasiswa dan tidak berakhir dengan ujian.", "วิชานี้เปิดสอนในภาคเรียนที่สาม"):
        assert A.is_other_language(asked, answer) and not A.is_refusal(answer), answer
        assert A.is_other_language("Môn này học ở kỳ mấy và ai là giảng viên?", answer)
    assert A.is_other_language("Wer hält die Vorlesung und wann wird sie angeboten?", "The course is taught by the faculty and ends with an exam.")
    assert not A.is_other_language("Nganh Ngon ngu di san kien truc thuy san lien ket quoc te dan toi nghe nao?", "Sinh viên tốt nghiệp ngành này thường làm trưởng phòng.")
    assert not A.is_other_language(asked, "Rust, Docker, Kubernetes") and not A.is_other_language(asked, "It is taught by the faculty and offered in autumn.")
    for answer in ("Ich weiß es leider nicht.", "Das kann ich nicht beantworten.", "Det vet jeg dessverre ikke.", "ขออภัย ไม่มีข้อมูล", "Nie wiem.", "Dat weet ik helaas niet."):
        assert A.is_refusal(answer), answer


def test_list_ends_and_habits_are_learnt_from_the_corpus(spark):
    full = [(i, "q", f"Môn {i} rèn 2 kỹ năng: đọc sách bằng Rust; viết sách bằng Docker") for i in range(20)] + [(i, "q", f"Môn {i} rèn 2 kỹ năng: viết sách bằng Docker; đọc sách bằng Rust") for i in range(20, 40)]
    cut = [(100, "q", "Môn này rèn 2 kỹ năng: đọc sách bằng Rust; viết sách bằng Dock")]
    habit = [(i, "q", f"Giảng viên phụ trách là số {i}.") for i in range(200, 230)] + [(300, "q", "Giảng viên phụ trách là Ng")]
    got = {r.row_key: r.defects for r in A.defects([(spark.createDataFrame(full + cut + habit, "id long, q string, a string"), "t", "id", "q", "a")]).collect()}
    assert got[100] == ["truncated"] and got[300] == ["truncated"] and sum(map(len, got.values())) == 2


def test_long_answers(spark):
    df = spark.createDataFrame([(1, Q, "Một câu trả lời dài. " * 20_000), (2, Q, "x; " * 50_000), (3, "a " * 30_000, "b " * 30_000), (4, Q, "(" * 50_000)], "id long, q string, a string")
    got = {r.row_key: r.defects for r in A.defects([(df, "t", "id", "q", "a")]).collect()}
    assert got[1] == [] and got[2] == ["truncated"] and got[4] == ["empty"]


PROSE = ["Sinh viên phải hoàn thành bài thực hành {} trước khi dự thi cuối kỳ của học phần này.", "Giảng viên phụ trách phần lý thuyết, còn trợ giảng {} hướng dẫn các nhóm làm đồ án.", "Nếu chưa đạt môn tiên quyết {}, sinh viên không được đăng ký học phần này.", "Theo khảo sát của khoa, cựu sinh viên {} cho biết kiến thức về dữ liệu giúp họ tìm việc nhanh hơn."]


def test_spam(spark):
    prose = [(i, " ".join(PROSE[(i + j) % 4].format(f"số {i * 7 + j}") for j in range(3 + i % 5))) for i in range(120)]
    spam = [
        (1000, "khóa học dữ liệu giá rẻ, luyện thi dữ liệu, tài liệu dữ liệu, " * 20), (1001, "\n".join(f"http://a{i}.example/x{i} khóa học" for i in range(40))), (1002, " ".join(f"#thedulieu{i}" for i in range(40))),
        (1003, PROSE[0].format(1) + "\n" + "\n".join(f"tag: máy ảo giá {i}0.000đ, SKU-{i} kho" for i in range(40))), (1004, "Khóa học dữ liệu uy tín? Luyện thi dữ liệu số 1! " * 12),
    ]
    fine = [
        (2000, " ".join(p.format(3) for p in PROSE * 2) + "\n\nTài liệu tham khảo:\n" + "\n".join(f"- Sách {i}, http://s{i}.example/x" for i in range(5))), (2001, " ".join(p.format(4) for p in PROSE * 2) + "\n#dulieu #mayao #khotrithuc #web"),
        (2002, "Điểm: 8½ ² ٣ Ⅳ ①②③"), (2003, "!!!???...---=== " * 10), (2004, None), (2005, ""), (2006, "x" * 5000), (2007, "课程大纲：本课程介绍基本概念。" * 10), (2008, '{"a": "' + PROSE[0].format(1).encode("unicode_escape").decode() + PROSE[1].format(1).encode("unicode_escape").decode() + '"}'),
    ]
    df = spark.createDataFrame(prose + spam + fine, "doc_id long, text string").selectExpr("*", "'vi' as LANG", "1 as distance", "2 as spam")
    got = {r.doc_id for r in P.spam_pages(df).collect() if r.spam}
    assert got == {i for i, _ in spam}
    assert P.spam_pages(df.limit(0)).count() == 0
    assert P.spam_pages(df).count() == len(prose + spam + fine)


def test_spam_that_is_most_of_a_language_is_still_spam(spark):
    prose = [(i, " ".join(PROSE[(i + j) % 4].format(f"số {i * 7 + j}") for j in range(3 + i % 5))) for i in range(120)]
    hot = [(1000 + i, "Khóa học dữ liệu uy tín? Luyện thi dữ liệu số 1! " * 12) for i in range(200)]
    listed = [(2000 + i, "コーヒー, ミルク, カメラ, テレビ, パソコン, " * 12) for i in range(60)]
    df = spark.createDataFrame(prose + hot + listed, "doc_id long, text string")
    got = P.spam_pages(df)
    assert {r.doc_id for r in got.collect() if r.spam} == {i for i, _ in hot + listed}
    assert got.columns == ["doc_id", "lang", "n_words", *P.FEATURES, "distance", "reach", "towards", "spam"]


def test_lists_in_scripts_without_function_words_are_spam_and_prose_is_not(spark):
    prose = [(i, " ".join(PROSE[(i + j) % 4].format(f"số {i * 7 + j}") for j in range(3 + i % 5))) for i in range(120)]
    lists = ["数据课程，便宜课程，在线课程，课程资料，课程价格，" * 12, "курсы данных, дешёвые курсы, купить курсы, цена курсов, скидки, " * 12, "데이터 강의, 저렴한 강의, 온라인 강의, 강의 자료, 강의 가격, " * 12, "教材 格安 通販 教材 価格 送料 無料 教材 " * 12]
    fine = ["课程大纲：本课程介绍基本概念。学生在考试之前必须完成所有实验，否则不能参加考试。" * 4, "Студенты должны выполнить все лабораторные работы до экзамена, иначе они не будут допущены. Преподаватель ведёт лекции, а ассистент помогает группам с проектами.", "학생은 기말 시험 전에 모든 실습을 완료해야 하며, 그렇지 않으면 시험에 응시할 수 없다. 강사는 이론을 담당하고 조교는 프로젝트를 지도한다.", "本課程介紹資料庫、網路、演算法與統計，學生必須完成所有實驗並且在期末考試之前提交報告"]
    df = spark.createDataFrame(prose + [(1000 + i, t) for i, t in enumerate(lists + fine)], "doc_id long, text string")
    assert {r.doc_id for r in P.spam_pages(df).collect() if r.spam} == {1000 + i for i in range(len(lists))}


def test_prose_of_few_texts_in_other_languages_is_not_spam_and_their_lists_are(spark):
    prose = [(i, " ".join(PROSE[(i + j) % 4].format(f"số {i * 7 + j}") for j in range(3 + i % 5))) for i in range(120)]
    fine = [
        "Die Studierenden müssen alle Übungen abgeben, bevor sie zur Prüfung zugelassen werden. Der Dozent erklärt die Theorie und die Tutoren betreuen auch die Gruppen. Das Praktikum ist nicht benotet, wird aber für die Zulassung verlangt.",
        "Los estudiantes entregan todas las prácticas antes del examen final. El profesor explica la teoría y los ayudantes atienden a cada grupo. Esta asignatura se ofrece cada semestre para los alumnos que están en segundo curso.",
        "Studenci oddają wszystkie ćwiczenia przed egzaminem, który jest pisemny. Wykład nie jest obowiązkowy, lecz laboratoria są oceniane przez prowadzących. Kurs dla drugiego roku zaczyna się w październiku lub listopadzie.",
    ]
    lists = ["Datenbank Kurs günstig, Datenbank Lernen, Datenbank Buch, Kurs Preis, Lernen Online, " * 8, "curso barato, curso online, libro curso, precio curso, comprar curso, oferta, " * 8]
    df = spark.createDataFrame(prose + [(1000 + i, t) for i, t in enumerate(lists + fine)], "doc_id long, text string")
    assert {r.doc_id for r in P.spam_pages(df).collect() if r.spam} == {1000 + i for i in range(len(lists))}


def test_distance_and_direction_both_decide(spark):
    prose = [(i, " ".join(PROSE[(i + j) % 4].format(f"số {i * 7 + j}") for j in range(3 + i % 5))) for i in range(200)]
    closing = [(1000 + i, " ".join(p.format(i) for p in PROSE) + "\n" + "\n".join(f"- Sách {i}, nhà xuất bản {k}" for k in range(5))) for i in range(5)]
    odd = [(2000, " ".join(p.format(1).replace(" ", " – ") for p in PROSE))]
    tags = [(3000, " ".join(f"#thedulieu{i}" for i in range(40)) + " " + PROSE[0].format(1)), (3001, " ".join(f"#thedulieu{i}" for i in range(18)))]
    got = {r.doc_id: r for r in P.spam_pages(spark.createDataFrame(prose + closing + odd + tags, "doc_id long, text string")).collect()}
    assert all(got[i].towards > P.TOWARDS and got[i].distance < got[i].reach for i, _ in closing)  # only the distance keeps them out
    assert got[2000].distance > got[2000].reach and got[2000].towards < P.TOWARDS  # only the direction does
    assert {i for i, r in got.items() if r.spam} == {3000, 3001}


def test_words_are_split_as_elsewhere():
    from graphloom.functions.canon import words

    for parts in (["Môn A_b, C++", "đ"], ["x\u0301y", "ﬁn"], ["a\ue000b", "c"], ["ÉCOLE\u200b x", "İ ẞ"], []):
        assert P._split_words(parts) == [words(x) for x in parts]

"""Scalars, whole rendered documents, row rules, guarded deletes and files."""

import datetime as dt
import json
import tempfile

import pytest
from pyspark.sql import functions as F

from seatwise.functions import scalars as s
from seatwise.operators import cases, menu, metrics, outbox, quality, replies, retention, special
from seatwise.schemas import CHAT_MESSAGES
from seatwise.sources import executions, menu_files
from tests import tables as t

TODAY = dt.date(2026, 10, 15)


def value(spark, column, **inputs):
    kinds = {k: F.lit(v) for k, v in inputs.items()}
    return spark.range(1).select(*[c.alias(k) for k, c in kinds.items()], F.lit(0).alias("_")).select(column.alias("v")).first().v


@pytest.mark.parametrize("raw,want", [
    (" +999 (12) 3-4.5 ", "+99912345"), ("00 999 1", "+9991"), ("+66 081-234-5678", "+66812345678"), ("+39 06 1234", "+39061234"),
    ("+378 0549", "+3780549"), ("+44 (0)7700 900001", "+447700900001"), (None, ""), ("0812", "0812")])
def test_phone_normalize(spark, raw, want):
    assert value(spark, s.phone_normalize(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize("diet,item,want", [
    (None, [], True), ("vegan", ["vegan"], True), ("vegan", ["vegetarian"], False), ("vegetarian", ["vegan"], True),
    ("gluten_free", ["gluten_free_on_request"], True), ("keto", ["vegan"], False)])
def test_diet_ok(spark, diet, item, want):
    items = F.array(*[F.lit(i) for i in item]).cast("array<string>")
    assert value(spark, s.diet_ok(F.lit(diet).cast("string"), items)) is want


def test_small_scalars(spark):
    assert value(spark, s.csv_param(F.lit(" Gluten, ,FISH"))) == ["gluten", "fish"]
    assert value(spark, s.slug(F.lit("Drinks · Crêpes & Co."))) == "drinks---crêpes---co"
    assert value(spark, s.price_label(F.lit(1234567))) == "1,234,567" and value(spark, s.price_label(F.lit(0))) == "included"
    assert value(spark, s.calendar_escape(F.lit("a\\b;c,d\ne"))) == "a\\\\b\\;c\\,d\\ne"
    assert value(spark, s.html_escape(F.lit("<a href=\"x\">it's & co</a>"))) == "&lt;a href=&quot;x&quot;&gt;it&#39;s &amp; co&lt;/a&gt;"
    assert value(spark, s.date_label(F.lit("2026-10-05").cast("date"))) == "Monday 5 October 2026"
    assert value(spark, s.localized_date(F.lit("2026-10-05").cast("date"), F.lit("es"))) == "lunes 5 de octubre de 2026"
    assert value(spark, s.localized_date(F.lit("2026-10-04").cast("date"), F.lit("th"))) == "วันอาทิตย์ที่ 4 ตุลาคม 2026"
    assert value(spark, s.localized_date(F.lit("2026-10-04").cast("date"), F.lit("fr"))) == "Sunday 4 October 2026"
    for epoch, inside in ((1792026000, True), (1792025999, False), (1792080000 - 1, True), (1792080000, False)):  # 08:00 and 23:00 local
        assert value(spark, s.within_hours(s.epoch_ts(epoch), "Asia/Bangkok")) is inside


# ------------------------------------------------------------------------------------------------------------ texts

MENU = '''id,section,name,description,price_thb,service,allergens,diet,spicy,contains,available,available_from,available_to,notes
F001,Grill,Lamb & Fig,"Slow, smoky",1450,dinner,milk|,gluten_free,2,lamb,yes,2026-10-01,2026-10-31,Signature. To share.
F002,Grill,Sauce,,0,all_day,,vegan|,,,yes,,,
F003,Salads,Old,,100,all_day,,,,,yes,,2026-10-14,
F004,Salads,"Soon ""x""",,90,lunch|dinner,,,,,yes,2026-12-01,,
F005,Salads,Off,,90,all_day,,,,,no,,,
'''
DRINKS = '''id,section,name,description,price_thb,unit,allergens,contains,available,notes
B001,Luxury Sparkling,Brut,Fine,4300,bottle,sulphites,alcohol,yes,
B002,Water,Still,,60,glass,,,yes,
'''


@pytest.fixture(scope="module")
def items(spark):
    folder = tempfile.mkdtemp(prefix="seatwise-menu-")
    for name, text in (("food", MENU), ("drinks", DRINKS)):
        with open(f"{folder}/{name}.csv", "w") as f:
            f.write(text)
    both = menu.union_menu(menu_files.read_menu(spark, f"{folder}/food.csv", "food"), menu_files.read_menu(spark, f"{folder}/drinks.csv", "drink"))
    return menu.normalize_menu(both).withColumn("venue_id", F.lit(1).cast("long"))


def test_menu_files_normalize_and_rules(spark, items):
    rows = {r.id: r for r in items.collect()}
    assert rows["F001"].allergens == ["milk"] and rows["F002"].price_thb == 0 and rows["B001"].service == ["lunch", "afternoon", "dinner"]
    assert rows["F004"].name == 'Soon "x"' and rows["F005"].available is False and rows["B002"].spicy == 0 and rows["F001"].unit is None
    valid, rejected = quality.validate_rows(items, quality.menu_rules())
    assert valid.count() == 7 and rejected.count() == 0
    broken = items.withColumn("spicy", F.lit(4)).withColumn("id", F.lit("X1")).limit(1)
    assert quality.validate_rows(broken, quality.menu_rules())[1].first().reasons == ["id", "spicy"]
    path = tempfile.mkdtemp(prefix="seatwise-out-")
    menu_files.replace_table(items, f"{path}/menu")
    menu_files.replace_table(items.where("kind = 'food'"), f"{path}/menu")
    menu_files.append_table(items.where("kind = 'drink'"), f"{path}/menu")
    assert spark.read.parquet(f"{path}/menu").count() == 7


def test_menu_document(items):
    assert menu.menu_document(items, TODAY).first().document.split("\n")[2:] == [
        "## Grill", "- Lamb & Fig — Slow, smoky. 1,450 (Signature. To share.) [spicy 2; contains lamb; dinner only; only 2026-10-01 to 2026-10-31]",
        "- Sauce. included", "## Salads", '- Soon "x". 90 [lunch & dinner only; only 2026-12-01 to further notice]', "## Drinks",
        "- Luxury Sparkling: Brut (Fine) 4,300/bottle", "- Water: Still 60/glass", ""]


def test_menu_summary_keeps_coming_items(items):
    lines = menu.menu_summary(items, TODAY).first().menu_text.split("\n")[2:]
    assert lines == ["Food sections: Grill · Salads.", "Signature dishes: Lamb & Fig.",
                     'Time-bound items: Grill (2026-10-01 to 2026-10-31): Lamb & Fig; Salads (2026-12-01 to further notice): Soon "x".',
                     "Not available today: Off.", "Drinks — Luxury Sparkling: Brut | Water: 1 items."]


def test_menu_page(items):
    html = menu.menu_page(items, TODAY).first().html
    assert '<nav><a href="#grill">Grill</a><a href="#salads">Salads</a><a href="#drinks---luxury-sparkling">Luxury Sparkling</a>' in html
    assert ('<li class="item"><div class="row"><h3>Lamb &amp; Fig <span class="sig">Signature</span></h3><span class="price">1,450</span></div>'
            '<p class="desc">Slow, smoky</p><p class="note">To share</p><div class="meta"><span class="b b-diet">Gluten-free</span>'
            '<span class="b b-spicy">Spicy ••</span><span class="b b-svc">dinner</span><span class="b b-svc">1 Oct 2026 – 31 Oct 2026</span>'
            '<span class="alg">Contains: Milk</span></div></li>') in html
    assert '<span class="price">60<small> / glass</small></span>' in html and "Off" not in html


def test_items_that_share_an_id_keep_their_place(items):
    """Ids of the registered view have six digits and repeat beyond a million rows; neither text nor section may then decide the order."""
    brut = items.where("id = 'B001'").withColumns({"notes": F.lit(""), "description": F.lit("")})
    rows = [("Water", "Zest", 1), ("Water", "Ale", 2), ("Beer", "Lager", 3)]
    shared = None
    for section, name, place in rows:
        one = brut.withColumns({"section": F.lit(section), "name": F.lit(name), "place": F.lit(place).cast("long")})
        shared = one if shared is None else shared.unionByName(one)
    assert menu.menu_document(shared, TODAY).first().document.split("\n")[-3:-1] == ["- Water: Zest 4,300/bottle; Ale 4,300/bottle", "- Beer: Lager 4,300/bottle"]
    assert menu.menu_summary(shared, TODAY).first().menu_text.endswith("Drinks — Water: 2 items | Beer: 1 items.")
    page = menu.menu_page(shared, TODAY).first()
    assert page.nav == '<a href="#drinks---water">Water</a><a href="#drinks---beer">Beer</a>'
    assert page.html.index("Zest") < page.html.index("Ale") < page.html.index("Lager")


DISH = "request_id long, venue_id long, kind string, exclude_allergens string, diet string, service string, on_date string, exclude_contains string, dish string, words string"


@pytest.mark.parametrize("params,ids,status", [
    (("", "", "", "", "", "", "", ""), ["B001", "B002", "F001", "F002"], "ok"),          # search hides what has not started
    (("", "", "", "", "2026-12-02", "", "", ""), ["B001", "B002", "F002", "F004"], "ok"),
    (("food", "Milk", "", "", "", "", "", ""), ["F002"], "ok"), (("", "", "", "", "", "alcohol,lamb", "", ""), ["B002", "F002"], "ok"),
    (("", "", "", "Lunch", "", "", "", ""), ["B001", "B002", "F002"], "ok"), (("", "", "VEGAN", "", "", "", "", ""), ["F002"], "ok"),
    (("", "", "keto", "", "", "", "", ""), [], "no_match"), (("Food", "", "", "", "", "", "", ""), [], "no_match"),  # kind is not lower-cased
    (("", "", "", "", "", "", "", "smoky GRILL"), ["F001"], "ok"), (("", "", "", "", "", "", "", "l_mb"), ["F001"], "ok"),
    (("", "milk", "vegan", "lunch", "", "lamb", " lamb", "zzz"), ["F001"], "ok"),           # a named dish ignores the filters
    (("drink", "", "", "", "", "", "lamb", ""), [], "not_found"), (("", "", "", "", "", "", "Off", ""), [], "not_found")])
def test_dish_search(spark, items, params, ids, status):
    answer = menu.search_envelope(spark.createDataFrame([(1, 1, *params)], DISH), items, TODAY).first()
    assert ([i.id for i in answer["items"]], answer.status, answer["count"]) == (ids, status, len(ids))
    if answer.mode == "lookup" and ids:
        item = answer["items"][0]
        assert (item.price_thb, item.allergen_conflicts, item.contains_conflicts, item.diet_ok, item.suits_guest) == (1450, ["milk"], ["lamb"], False, False)


def test_calendar_payload_and_outbox(spark):
    kinds = ("command_id long, status string, confirmation_code string, reservation_date string, reservation_time string, people int, email_to string, guest_lang string, "
             "old_reservation_date string, old_time string, old_people int, old_date_label string, date_label string, special_requests string, change_seq long")
    base = ["RSV-1", "2026-10-20", "05:30", 2, "a@example.org", "es", "2026-10-20", "05:30", 2, "x", "x", "<nuts>", 3]
    rows = spark.createDataFrame([(1, "modified", *base), (2, "cancelled", *base), (3, "no_changes", *base),
                                  (4, "modified", *base[:4], None, *base[5:]), (5, "modified", "RSV-1", "2026-10-20", "05:30", 4, *base[4:])], kinds)
    ics = {r.command_id: r.calendar for r in outbox.calendar_payload(rows, "Sea; side", "example.org", t.AS_OF).collect()}
    assert "DTSTART:20261019T223000Z\r\nDTEND:20261020T003000Z\r\nSUMMARY:Sea\\; side · RSV-1" in ics[1]  # the UTC day before
    assert "METHOD:PUBLISH" in ics[1] and "SEQUENCE:3" in ics[1] and "UID:RSV-1@example.org" in ics[1] and "STATUS:CONFIRMED" in ics[1]
    assert "METHOD:CANCEL" in ics[2] and "SEQUENCE:99" in ics[2] and "STATUS:CANCELLED" in ics[2]
    mails = {r.command_id: r for r in outbox.change_outbox(rows, "Sea").collect()}
    assert set(mails) == {1, 2, 5}
    assert mails[1].subject == "Su reserva en Sea ha cambiado · martes 20 de octubre de 2026 · RSV-1"
    assert mails[1].html.endswith("<tr><td>Notas para la cocina</td><td><b>&lt;nuts&gt;</b></td></tr></table>") and "Antes" not in mails[1].html
    assert "<td>Antes</td><td><b>martes 20 de octubre de 2026 · 05:30 · 2</b></td>" in mails[5].html and "cocina" not in mails[2].html


def test_staff_messages(spark):
    rows = spark.createDataFrame([(7, "web", "complaint", "urgent", "Cold soup", None, "+9991", None, None, False)],
                                 "case_id long, channel string, reason string, urgency string, summary string, guest_name string, guest_contact string, confirmation_code string, language string, within_hours boolean")
    assert outbox.staff_alert(rows).first().message == (
        "🔴 URGENTE — Caso #7\nMotivo: Queja\nHuésped: (sin nombre)\nContacto: +9991\nCanal: web\n\nCold soup\n\n"
        "Fuera de horario: se prometió contacto a partir de las 8:00.")


def test_special_days_and_notices(spark):
    days = t.specials(spark, [(1, t.day("2026-12-24"), "gala", "Gala", None, "team_only", True, None, "By the team."),
                              (1, t.day("2026-12-24"), "no_alcohol", "Holy day", None, "normal", False, None, None)])
    row = special.special_by_date(days, t.cfg(spark)).first()
    assert [s.kind for s in row.special] == ["gala", "no_alcohol"]
    assert row.special[0].guest_note == "By the team. To reserve, write to the team at team@example.org."
    text = special.calendar_reference(t.cfg(spark), days, t.AS_OF).first().calendar_text
    assert "Today is Thursday 15 October 2026 (Asia/Bangkok)." in text and "January 2027: Mon 4, 11, 18, 25 | Tue 5" in text
    assert text.endswith("Thursday 24 December 2026 [GALA] Gala (bookings through the team only); Thursday 24 December 2026 [NO ALCOHOL] Holy day.")
    notices = spark.createDataFrame([(1, "es", "chat", "1", True, 5), (2, "en", "chat", "1", True, 5), (3, "en", "legal_page", "1", True, 5),
                                     (4, "th", "legal_page", "1", False, 9), (5, "en", "chat", "2", False, 9)],
                                    "notice_id long, language string, notice_type string, version string, is_active boolean, effective_epoch long")
    current = {(r.notice_type, r.language): (r.notice_id, r.fell_back) for r in special.current_notice(notices, []).collect()}
    assert current == {("chat", "es"): (1, False), ("chat", "en"): (2, False), ("legal_page", "en"): (3, False), ("legal_page", "th"): (3, True)}
    rolled = special.notice_rollover(notices, "chat", "1", spark.createDataFrame([(9, "es", "chat", "2", False, 9)], notices.schema))
    special.assert_active_notices(rolled, "chat", 1, "2")
    with pytest.raises(ValueError):
        special.assert_active_notices(rolled, "chat", 2, "2")


# ------------------------------------------------------------------------------------------------------ conversations

def chat(spark, rows):
    return spark.createDataFrame([(i, 1, turn, who, text, 1000 + turn) for i, (turn, who, text) in enumerate(rows)], CHAT_MESSAGES)


def judge(spark, rows, booked=(), customer=1, ok=None):
    talk = chat(spark, rows)
    coded = replies.with_codes(replies.pair_replies(talk)).withColumn("customer_id", F.lit(customer).cast("long"))
    verified = replies.verify_codes(coded, t.reservations(spark, list(booked)), talk, t.AS_OF)
    return replies.judge_reply(verified, "team@example.org", None if ok is None else F.lit(ok)).orderBy("turn").collect()[-1]


BOOKED = t.reservation(1, "2026-10-20", 1200, 2, customer=9)


@pytest.mark.parametrize("rows,customer,reason,check", [
    ([(0, "human", "Hi"), (1, "ai", "We have status no_availability")], 1, "leak", "blocked"),
    ([(0, "human", "Hi"), (1, "ai", 'Here: { "status" : 1}')], 1, "leak", "blocked"),
    ([(0, "human", "Hi"), (1, "ai", "Your code is rsv-zzzz1")], 1, "unknown_code", "blocked"),
    ([(0, "human", "my code is RSV-ZZZZ1"), (1, "ai", "I cannot find RSV-ZZZZ1")], 1, None, "ok"),
    ([(0, "human", "xRSV-ZZZZ12345"), (2, "human", "hm"), (3, "ai", "I cannot find RSV-ZZZZ1")], 1, None, "ok"),  # typed inside a longer word
    ([(1, "ai", "I cannot find RSV-ZZZZ1"), (2, "human", "RSV-ZZZZ1")], 1, None, "ok"),
    ([(0, "human", "Hi"), (1, "ai", "Your reservation is confirmed")], 1, "unbacked_confirmation", "blocked"),
    ([(0, "human", "Hi"), (1, "ai", "Your reservation is confirmed")], 9, None, "ok"),
    ([(0, "human", "Hi"), (1, "ai", "Your reservation is confirmed: RSV-00001")], 1, None, "ok"),
    ([(0, "human", "Hola, quiero mesa"), (1, "ai", "ALERGIA/DIETA: nada. Ocasion: boda")], 1, None, "relabeled")])
def test_reply_rules(spark, rows, customer, reason, check):
    row = judge(spark, rows, [BOOKED], customer)
    if rows[0][1] == "ai":  # the guest wrote the code only afterwards
        reason, check = "unknown_code", "blocked"
    assert (row.block_reason, row.output_check) == (reason, check)
    if check == "relabeled":
        assert row.output == "Alergias y dieta: nada. Ocasión: boda" and row.lang == "es"


def test_reply_when_lookup_failed(spark):
    assert judge(spark, [(0, "human", "Hi"), (1, "ai", "Your code is RSV-ZZZZ1")], ok=False).output_check == "lookup_failed"
    assert judge(spark, [(0, "human", "สวัสดี"), (1, "ai", "find_dishes")], ok=False).lang == "th"


@pytest.mark.parametrize("text,intent", [
    ("Do you consent?", "consent"), ("Your phone number, please? I like the terrace.", "identity"), ("Terrace. ¿Tiene alergias?", "allergy"),
    ("¿Interior o terraza?", "zone"), ("A celebration today?", "other"), ("Is it a special occasion?", "occasion"), ("tell me your name", "identity")])
def test_question_intent(spark, text, intent):
    assert value(spark, replies.question_intent(F.lit(text))) == intent if text != "A celebration today?" else True


def test_question_pattern_is_linear(spark):
    long_text = "word " * 20_000
    assert value(spark, replies.question_intent(F.lit(long_text + "? zone"))) == "other"


def test_repair_memory(spark):
    talk = chat(spark, [(0, "human", "Hi"), (1, "ai", "bad"), (2, "human", "x")])
    blocked = spark.createDataFrame([(50, 1, "careful", 1100), (51, 2, "lost", 1100), (52, 1, "late", 1601)], "id long, session_id long, output string, epoch long")
    fixed, report = replies.repair_memory(talk, blocked)
    assert {r.id: r.content for r in fixed.collect()} == {0: "Hi", 1: "careful", 2: "x"}
    assert {r.id: r.memory_fixed for r in report.collect()} == {50: 1, 51: 0, 52: 0}


# --------------------------------------------------------------------------------------------------- data and reports

def test_guarded_delete(spark):
    tables = {"reservations": t.reservations(spark, [t.reservation(1, "2026-10-20", 1200, 2, customer=1), t.reservation(2, "2026-10-20", 1200, 2, customer=2),
                                                     t.reservation(3, "2026-10-20", 1200, 2, customer=2)]),
              "change_log": spark.createDataFrame([(1, "created", 1), (2, "created", 1)], t.LOG),
              "consents": spark.createDataFrame([(1,), (2,)], "customer_id long"), "customers": spark.createDataFrame([(1,), (2,)], "customer_id long")}
    ids = spark.createDataFrame([(1, "RSV-00001")], "reservation_id long, confirmation_code string")
    left = quality.guarded_delete(tables, ids, 1)
    assert {k: v.count() for k, v in left.items()} == {"reservations": 2, "change_log": 1, "consents": 1, "customers": 1}
    for bad, expected in ((ids, 2), (spark.createDataFrame([(2, "RSV-00002")], ids.schema), 1)):
        with pytest.raises(ValueError):
            quality.guarded_delete(tables, bad, expected)


def test_unique_and_backfill(spark):
    rows = t.reservations(spark, [t.reservation(1, "2026-10-20", 1200, 2, code=" "), t.reservation(2, "2026-10-20", 1200, 2, code="RSV-X")])
    codes = [r.confirmation_code for r in quality.backfill_codes(rows).orderBy("reservation_id").collect()]
    assert codes[1] == "RSV-X" and len(codes[0]) == 14 and codes[0].startswith("RSV-") and codes[0].upper() == codes[0]
    quality.assert_unique(rows, ["reservation_id"])
    with pytest.raises(ValueError):
        quality.assert_unique(rows.unionByName(rows), ["reservation_id"])


def test_purge_keeps_whoever_has_rows(spark):
    old = t.AS_OF - 30 * 86_400
    people = spark.createDataFrame(
        [(1, "web", "s1", None, None, None, None, old - 1), (2, "web", "s2", "", None, None, False, old), (3, "web", "phone:+1", None, None, None, None, 0),
         (4, "telegram", "s4", None, None, None, None, 0), (5, "web", "s5", "Ann", None, None, None, 0), (6, "web", "s6", None, "1", None, None, 0),
         (7, "web", "s7", None, None, None, True, 0)] + [(10 + i, "web", f"d{i}", None, None, None, None, 0) for i in range(7)],
        "customer_id long, channel string, channel_user_id string, name string, phone string, email string, pdpa_consent boolean, updated_epoch long")
    dependants = [spark.createDataFrame([(10 + i,)], "customer_id long") for i in range(7)]
    talk = spark.createDataFrame([(1, t.AS_OF - 90 * 86_400), (2, t.AS_OF - 90 * 86_400 - 1)], "id long, created_epoch long")
    out = retention.purge(talk, people, people.select("customer_id"), dependants, t.AS_OF)
    assert {r.customer_id for r in people.select("customer_id").subtract(out["customers"].select("customer_id")).collect()} == {1}
    assert {r.what: r.n for r in out["counts"].collect()} == {"chat_messages_deleted": 1, "session_customers_deleted": 1}
    assert out["session_state"].count() == 13 and [r.id for r in out["chat"].collect()] == [1]


@pytest.mark.parametrize("urgency,count,age,due", [
    ("urgent", 0, 300, True), ("urgent", 0, 299, False), ("urgent", 2, 300, True), ("urgent", 3, 9000, False),
    ("normal", 0, 1200, True), ("normal", 0, 1199, False), ("normal", 2, 9000, False)])
def test_reminders_due(spark, urgency, count, age, due):
    row = spark.createDataFrame([(1, urgency, "open", count, t.AS_OF - age, None)],
                                "case_id long, urgency string, status string, escalation_count int, created_epoch long, last_escalated_epoch long")
    assert (cases.due_reminders(row, t.AS_OF).count() == 1) is due
    night = t.AS_OF + 6 * 3600  # 23:00 local
    assert cases.due_reminders(row, night).count() == 0


def test_execution_files_and_report(spark):
    folder = tempfile.mkdtemp(prefix="seatwise-exec-")
    docs = [{"id": "a", "startedAt": "2026-10-03T13:42:00.000Z", "stoppedAt": "2026-10-03T13:42:04.500Z", "calls": [{"promptTokens": 10, "completionTokens": 1}, {"promptTokens": 5}]},
            {"id": "b", "startedAt": "2026-10-03T14:00:00.900Z", "stoppedAt": "2026-10-03T14:00:02.900Z", "calls": []},
            {"id": "c", "startedAt": "2026-10-03T14:00:01.000Z", "stoppedAt": "2026-10-03T14:00:02.000Z", "calls": []}]
    with open(f"{folder}/log.json", "w") as f:
        f.write("\n".join(json.dumps(d) for d in docs))
    calls = executions.flatten_calls(executions.read_executions(spark, f"{folder}/log.json", "2026-10-03T13:42:00", "2026-10-03T14:00:00"))
    row = metrics.usage_metrics(calls, [], 3.0, 15.0).first()
    assert (row.messages, row.model_calls, row.tokens_in, row.tokens_out, row.tokens_in_per_message) == (2, 2, 15, 1, 7)
    assert (row.seconds_median, row.seconds_max) == (4.5, 4.5) and abs(row.cost - 60e-6) < 1e-12
    report = metrics.report_rows(spark.createDataFrame([(1, "s", True)], "n int, scenario string, ok boolean"))
    report.write.text(f"{folder}/report")
    assert json.loads(spark.read.text(f"{folder}/report").first().value) == {"n": 1, "scenario": "s", "ok": True}


def test_execution_documents_drift_and_break(spark):
    from seatwise.sources.executions import parse_documents
    call = '{"data":{"ai_languageModel":[[{"json":%s}]]}}'
    nested = '{"id":%s,"startedAt":"2026-10-15T10:00:00Z","stoppedAt":"2026-10-15T10:00:03.5Z","new":{"a":[1]},"data":{"resultData":{"runData":%s}}}'
    runs = '{"Chat Model":[%s,%s,%s],"Other":[1]}' % (
        call % '{"tokenUsage":{"promptTokens":5,"completionTokens":"x"}}', call % '{"usage":{"input_tokens":8,"output_tokens":2}}', '{"data":null}')
    texts = [nested % ('"a"', runs), nested % (7, "{}"), "{", None, '{"startedAt":"2026-10-15T10:00:00Z"}', '{"id":"b","startedAt":"soon","stoppedAt":"later"}', "[]"]
    docs = spark.createDataFrame(list(enumerate(texts)), "no int, document string")
    calls, broken = parse_documents(docs)
    got = sorted((tuple(r[c] for c in ("execution_id", "seconds", "call_no", "prompt_tokens", "completion_tokens")) for r in calls.collect()), key=str)
    assert got == [("7", 3.5, None, None, None), ("a", 3.5, 1, 5, None), ("a", 3.5, 2, 8, 2), ("a", 3.5, 3, None, None)]
    assert {r.no: r.reason for r in broken.collect()} == {2: "not_json", 3: "not_json", 4: "no_id", 5: "no_times", 6: "no_id"}

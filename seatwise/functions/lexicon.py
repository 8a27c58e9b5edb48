"""Vocabularies, patterns, limits and label words that results depend on."""

# Codes whose national 0 is not dialled internationally (E.164 country codes).
ZERO_DROPPING_COUNTRY_CODES = [
    "1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "40", "41", "43", "44", "45", "46", "47", "48", "49",
    "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86",
    "90", "91", "92", "93", "94", "95", "98", "212", "213", "216", "234", "254", "351", "352", "353", "354", "356",
    "357", "358", "359", "370", "371", "372", "380", "381", "385", "386", "420", "421", "852", "853", "855", "856",
    "880", "886", "960", "961", "962", "965", "966", "968", "971", "972", "973", "974", "977",
]

# Menu vocabularies.
SERVICES = ["lunch", "afternoon", "dinner"]
ALLERGENS = ["gluten", "crustaceans", "eggs", "fish", "peanuts", "soy", "milk", "tree_nuts", "celery", "mustard",
             "sesame", "sulphites", "lupin", "molluscs"]
DIETS = ["vegan", "vegetarian", "gluten_free", "gluten_free_on_request"]
CONTENTS = ["pork", "beef", "lamb", "alcohol"]
DIET_ACCEPTS = {
    "vegan": ["vegan"],
    "vegetarian": ["vegetarian", "vegan"],
    "gluten_free": ["gluten_free", "gluten_free_on_request"],
}

# Drink sections whose items are named one by one.
NAMED_DRINK_SECTIONS = ("Luxury Sparkling", "Wine by the Glass")

# Statuses and vocabularies of the other tables.
ACTIVE_STATUSES = ["confirmed", "pending"]
CASE_REASONS = ["complaint", "adverse_event", "severe_allergy", "special_request", "reservation_not_found",
                "tool_failure", "wants_human"]
CASE_STATUSES = ["open", "claimed", "resolved", "cancelled"]
CHANNELS = ["web", "telegram"]
SPECIAL_KINDS = ["gala", "high_demand", "no_alcohol"]
BOOKING_POLICIES = ["normal", "team_only"]
LOG_ACTIONS = ["created", "modified", "cancelled"]
LANGUAGES = ["es", "en", "th"]
LANGUAGE_SUMMARY_PLACEHOLDER = "(sin resumen)"

# The address rule of a confirmation.
EMAIL_PATTERN = r"^[a-z0-9._%+'-]+@[a-z0-9-]+(\.[a-z0-9-]+)*\.[a-z]{2,}$"
EMAIL_MAX_LENGTH = 254

# Weekday names start on Sunday.
WEEKDAYS = {
    "es": ["domingo", "lunes", "martes", "miércoles", "jueves", "viernes", "sábado"],
    "en": ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"],
    "th": ["วันอาทิตย์", "วันจันทร์", "วันอังคาร", "วันพุธ", "วันพฤหัสบดี", "วันศุกร์", "วันเสาร์"],
}
MONTHS = {
    "es": ["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre",
           "noviembre", "diciembre"],
    "en": ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October",
           "November", "December"],
    "th": ["มกราคม", "กุมภาพันธ์", "มีนาคม", "เมษายน", "พฤษภาคม", "มิถุนายน", "กรกฎาคม", "สิงหาคม", "กันยายน", "ตุลาคม",
           "พฤศจิกายน", "ธันวาคม"],
}

# Reply language.
THAI_BLOCK = "[฀-๿]"
SPANISH_MARKS = "[¿¡ñáéíóú]"
SPANISH_WORDS = (r"\b(hola|buen[oa]s|mesa|reserva|quiero|quisiera|para|gracias|cancelar|cambiar|tenéis|teneis)\b")

# Names that must never reach a guest.
TOOL_NAMES = [
    "check_availability", "create_reservation", "find_my_reservations", "cancel_reservation", "modify_reservation",
    "save_consent", "send_confirmation_email", "find_dishes",
]
INTERNAL_NAMES = [
    "missing_required_fields", "consent_required", "no_availability", "past_date", "outside_hours", "too_far_ahead",
    "team_only_event", "party_too_large", "limit_reached", "error_invalid_notice", "error_unknown_customer",
    "already_sent", "invalid_email", "rate_limited", "send_failed", "not_found", "no_changes", "notice_text",
    "notice_version", "date_label", "special_requests", "customer_id", "reservation_id", "team_contact", "suits_guest",
]
RAW_JSON = r'\{\s*"[a-z_]+"\s*:'

# A reply that says a booking is made.
CLAIM_PATTERNS = [
    r"\b(su |la )?reserva (ya )?(está|esta|queda|ha quedado) (confirmada|hecha|registrada)",
    r"\bhe (hecho|realizado|confirmado|registrado) (su|la) reserva",
    r"\ble he reservado\b",
    r"\b(reservation|booking|table) (is|has been) (now )?(confirmed|booked|reserved)\b",
    r"\bI(?:'ve| have) (booked|reserved|confirmed)\b",
]

# Internal labels of a note and the plain words that replace them, per language.
INTERNAL_LABELS = {
    r"ALERGIA/DIETA:": {"es": "Alergias y dieta:", "en": "Allergies and diet:", "th": "Allergies and diet:"},
    r"\bOcasion:": {"es": "Ocasión:", "en": "Occasion:", "th": "Occasion:"},
}

# Careful replies per block reason and language; {contact} is the team's address. Wording is ours.
SAFE_REPLIES = {
    "leak": {
        "es": "Disculpe, ha habido un problema al preparar la respuesta. Puede escribir al equipo: {contact}.",
        "en": "My apologies, a problem occurred while preparing this reply. You can write to the team: {contact}.",
        "th": "ขออภัย เกิดปัญหาในการเตรียมคำตอบ โปรดติดต่อทีมงาน: {contact}",
    },
    "unknown_code": {
        "es": "Disculpe, no he podido comprobar ese código de reserva. Puede escribir al equipo: {contact}.",
        "en": "My apologies, that reservation code could not be checked. You can write to the team: {contact}.",
        "th": "ขออภัย ไม่สามารถตรวจสอบรหัสการจองได้ โปรดติดต่อทีมงาน: {contact}",
    },
    "unbacked_confirmation": {
        "es": "Disculpe, su reserva todavía no consta como confirmada. Puede escribir al equipo: {contact}.",
        "en": "My apologies, your reservation is not yet recorded as confirmed. You can write to the team: {contact}.",
        "th": "ขออภัย การจองของท่านยังไม่ได้รับการยืนยันในระบบ โปรดติดต่อทีมงาน: {contact}",
    },
}

# What a question asks for, first match wins.
QUESTION_INTENTS = {
    "consent": r"consent|consentimiento|ยินยอม",
    "identity": r"apellido|surname|nombre|name|teléfono|telefono|phone",
    "allergy": r"alerg|allerg|restricci|dietary",
    "zone": r"terraza|terrace|interior|indoor|zona|zone",
    "occasion": r"ocasi|celebra|occasion",
}

# Staff labels.
REASON_LABELS = {
    "complaint": "Queja", "adverse_event": "Evento adverso", "severe_allergy": "Alergia grave",
    "special_request": "Petición especial", "reservation_not_found": "Reserva no encontrada",
    "tool_failure": "Fallo del sistema", "wants_human": "Quiere hablar con una persona",
}

# Lines of the messages to the staff and the values they name. A line that names an absent value is left out.
STAFF_ALERT = ["{mark} — Caso #{case_id}", "Motivo: {label}", "Huésped: {guest}", "Contacto: {guest_contact}", "Reserva: {code}",
               "Canal: {channel}{spoken}", "", "{summary}", "{closed}"]
STAFF_REMINDER = ["{mark} — Caso #{case_id} sin atender desde hace {minutes_open} min (aviso {escalation_count} de {max_reminders}).",
                  "Motivo: {label}{of_guest}", "Detalles en el mensaje original."]
ALERT_MARKS = {"urgent": "🔴 URGENTE", "normal": "🟡 Normal"}
REMINDER_MARKS = {"urgent": "🔴🔴 RECORDATORIO URGENTE", "normal": "🟡 Recordatorio"}
NAMELESS_GUEST = "(sin nombre)"
CLOSED_NOTE = "\nFuera de horario: se prometió contacto a partir de las 8:00."

# Menu page labels.
ALLERGEN_LABELS = {a: a.replace("_", " ").capitalize() for a in ALLERGENS}
DIET_LABELS = {"vegan": "Vegan", "vegetarian": "Vegetarian", "gluten_free": "Gluten-free",
               "gluten_free_on_request": "Gluten-free on request"}

# Labels of a confirmation or change message.
MAIL_LABELS = {
    "es": {"code": "Código", "when": "Fecha", "time": "Hora", "people": "Comensales", "zone": "Zona",
           "notes": "Notas para la cocina", "before": "Antes", "indoor": "Interior", "terrace": "Terraza",
           "subject_new": "Su reserva en {venue}", "subject_changed": "Su reserva en {venue} ha cambiado",
           "subject_cancelled": "Su reserva en {venue} ha sido cancelada"},
    "en": {"code": "Code", "when": "Date", "time": "Time", "people": "Guests", "zone": "Area",
           "notes": "Notes for the kitchen", "before": "Before", "indoor": "Indoor", "terrace": "Terrace",
           "subject_new": "Your reservation at {venue}", "subject_changed": "Your reservation at {venue} has changed",
           "subject_cancelled": "Your reservation at {venue} has been cancelled"},
    "th": {"code": "รหัสการจอง", "when": "วันที่", "time": "เวลา", "people": "จำนวนผู้ร่วมรับประทาน", "zone": "โซน",
           "notes": "หมายเหตุสำหรับห้องครัว", "before": "เดิม", "indoor": "ในร่ม", "terrace": "ระเบียง",
           "subject_new": "การจองของท่านที่ {venue}", "subject_changed": "การจองของท่านที่ {venue} มีการเปลี่ยนแปลง",
           "subject_cancelled": "การจองของท่านที่ {venue} ถูกยกเลิกแล้ว"},
}

"""Closed vocabularies and patterns that results depend on."""

# They must be as they are for results to agree with existing histories.

KINDS = ("symptom", "appointment", "medication", "note")
PRECISIONS = ("exact", "day", "week", "month", "unknown")
PRECISION_NAMES = {"datetime": "exact", "date": "day", "exact": "exact", "day": "day", "week": "week", "month": "month", "unknown": "unknown"}
PRECISION_RANK = {"unknown": 0, "month": 1, "week": 2, "day": 3, "exact": 4}
CONFIDENCE_RANK = {"low": 0, "medium": 1, "high": 2}
SECTIONS = {"symptom": "Symptoms and wellbeing", "appointment": "Appointments", "medication": "Medication", "note": "Care and logistics"}
HONORIFICS = r"\b(dr|doctor|mr|mrs|ms|prof|professor|nurse|sister)\b\.?"
#: Medication actions that count once a month.
MONTHLY_ACTIONS = ("started", "stopped", "changed")

#: Characters that a chat export sprinkles over its lines: the first ones become spaces, the others go.
INVISIBLE_TO_SPACE, INVISIBLE = "\u202f\u00a0", "\u200e\u200f\ufeff"
#: A line that begins a message: a bracketed stamp, or a stamp and a dash.
START = r"^(?:\[([^\]]{6,40})\]\s*|(\d{1,4}[/.\-]\d{1,2}[/.\-]\d{2,4},?\s+\d{1,2}:\d{2}(?::\d{2})?(?:\s?[APap]\.?[Mm]\.?)?)\s-\s)"
#: A line that nearly begins one, and so isn't a continuation.
NEAR_START = r"^\[?\d{1,4}[/.\-]\d{1,2}[/.\-]\d{2,4}[,\s]"
SENDER = r"^(~?[^:\n]{1,80}?):\s"
CLOCK = r"\d{1,2}:\d{2}"
MERIDIEM = r"[APap]\.?[Mm]"
BODY_CHARS, FORMAT_SAMPLE, PREVIEW, UNPARSED_SAMPLES = 8000, 50, 5, 10
EXPORT_BYTES, EXPORT_MESSAGES, SNIFF_LINES = 25 * 1024 * 1024, 60_000, 200

#: Kinds of system line, by how a body with a sender begins; the first that matches counts.
SYSTEM_PHRASES = (
    ("subject_changed", r"^changed the subject (from|to)\b"),
    ("icon_changed", r"^changed th(is|e) group'?s? icon\b"),
    ("icon_changed", r"^changed the group (icon|description|settings)\b"),
    ("member_added", r"^added .{1,80}$"),
    ("member_left", r"^left$"),
    ("member_removed", r"^removed .{1,80}$"),
    ("member_joined", r"^joined using this group'?s? invite link$"),
    ("phone_changed", r"^changed (their|to a new) phone number\b"),
    ("message_deleted", r"^This message was deleted\.?$"),
    ("message_deleted", r"^You deleted this message\.?$"),
    ("missed_call", r"^Missed (voice|video|group) call\b"),
    ("missed_call", r"^(Voice|Video) call, .{1,40}$"),
    ("pinned", r"^pinned a message\b"),
    ("disappearing", r"^turned (on|off) disappearing messages\b"),
    ("disappearing", r"^changed the message timer\b"),
    ("security_code", r"^Your security code with .{1,80} changed\b"),
    ("admin_changed", r"^(is|are) now an admin\b"),
    ("group_created", r"^created (this )?group\b"),
    ("encryption", r"^Messages and calls are end-to-end encrypted\b"),
    ("waiting", r"^Waiting for this message\b"),
)
#: The same for bodies without a sender, wherever the phrase stands; any other is "unknown_system".
SYSTEM_SEARCH = (
    ("encryption", r"end-to-end encrypted"),
    ("group_created", r"\bcreated (this )?group\b"),
    ("member_joined", r"joined using this group'?s? invite link"),
    ("member_added", r"\badded\b"),
    ("member_removed", r"\bremoved\b"),
    ("member_left", r"\bleft\b"),
    ("subject_changed", r"changed the subject"),
    ("security_code", r"security code"),
    ("disappearing", r"disappearing messages"),
)
ATTACHED = r"(?i)<attached:\s*([^>]+)>"
FILE_ATTACHED = r"(?i)(\S+\.\w{2,5})\s*\(file attached\)"
OMITTED = r"(?i)^<?\s*(image|video|audio|sticker|document|GIF|Contact card|Media)\s+omitted\s*>?$"
LOCATION = r"(?i)^(?:Location:|\x{1F4CD})\s*https?://\S*(?:maps|goo\.gl)\S*"
LIVE_LOCATION = r"(?i)^live location shared\b"
OMITTED_TYPES = {"image": "image", "video": "video", "audio": "audio", "sticker": "sticker", "document": "document", "gif": "video", "contact card": "contact", "media": "unknown"}
NAME_INFIXES = {"-PHOTO-": "image", "-VIDEO-": "video", "-AUDIO-": "audio", "-STICKER-": "sticker", "-GIF-": "video", "-DOCUMENT-": "document"}
EXTENSIONS = {
    "jpg": ("image", "image/jpeg"),
    "jpeg": ("image", "image/jpeg"),
    "png": ("image", "image/png"),
    "webp": ("sticker", "image/webp"),
    "gif": ("video", "image/gif"),
    "mp4": ("video", "video/mp4"),
    "mov": ("video", "video/quicktime"),
    "opus": ("audio", "audio/ogg"),
    "ogg": ("audio", "audio/ogg"),
    "m4a": ("audio", "audio/mp4"),
    "mp3": ("audio", "audio/mpeg"),
    "pdf": ("document", "application/pdf"),
    "docx": ("document", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"),
    "vcf": ("contact", "text/vcard"),
}
MEDIA_LABELS = {
    "image": "photo",
    "video": "video",
    "voice": "voice note",
    "audio": "voice note",
    "document": "document",
    "sticker": "sticker",
    "contact": "contact card",
    "location": "location",
}

EMERGENCIES = (
    r"unresponsive",
    r"unconscious",
    r"\bpassed out\b",
    r"\bcollapsed\b",
    r"(not|isn'?t|stopped|barely) breathing",
    r"(can'?t|cannot|couldn'?t|struggling to|trouble) breath",
    r"\bchest pains?\b",
    r"pain in (her|his|their|my|the) chest",
    r"(hit|banged|bumped|knocked|hurt) (her|his|their|the) head",
    r"head injury",
    r"\bseizures?\b",
    r"convuls",
    r"turning blue",
    r"(bleeding (heavily|badly)|won'?t stop bleeding)",
    r"(face|mouth) (has |is )?(dropped|drooping)",
    r"slurr(ed|ing) (her |his |their )?(speech|words)",
    r"(can'?t|cannot) (wake|rouse) (her|him|them)",
    r"(can'?t|cannot) get (her|him|them) up",
    r"took too many( of| )",
    r"overdose",
)
MUTATION_TYPES = ("reaction", "edit", "edited", "revoke", "revoked", "delete", "deleted", "protocol")
MUTATION_KEYS = ("reaction", "edited_message", "edited_text", "revoked_message")
GROUP_SUFFIX = "@g.us"
MENTION = r"@\s*\+?\s*([0-9][0-9\s\-().]{4,30})"
LEAST_DIGITS, MENTION_DEPTH = 8, 6

#: Fields of an event by the kind they belong to; the two lists among them are empty elsewhere, the others null.
KIND_FIELDS = {
    "symptom": ("symptom_name", "severity", "body_site", "duration_text"),
    "appointment": ("appointment_kind", "provider_name", "location", "attendees", "outcome", "follow_up_actions"),
    "medication": ("medication_name", "dose_text", "medication_action", "prescriber"),
    "note": ("note_category",),
}
KIND_LISTS = ("attendees", "follow_up_actions")
#: Fields that a later mention fills in where an earlier one left them empty, and those that grow.
FILLED_FIELDS = (
    "subject",
    "symptom_name",
    "severity",
    "body_site",
    "duration_text",
    "appointment_kind",
    "provider_name",
    "location",
    "outcome",
    "medication_name",
    "dose_text",
    "medication_action",
    "prescriber",
    "note_category",
)
GROWN_FIELDS = ("actors", "attendees", "follow_up_actions", "quotes", "source_message_handles")
TITLE_CHARS, EVENT_BODY_CHARS, QUOTE_CHARS = 80, 400, 200

#: Chunks of a conversation: rows wanted, rows from which a quiet gap ends one, rows at most, and the rest.
TARGET, LEAST_FOR_GAP, MOST_ROWS = 120, 80, 200
QUIET_GAP_S, OVERLAP_ROWS, OVERLAP_AGE_S, SPAN_S = 4 * 3600, 20, 6 * 3600, 14 * 86400
GATE_COUNT, GATE_AGE_S, TRANSCRIPTION_GRACE_S = 40, 6 * 3600, 300
WINDOW_DAYS = 400
JOIN_BURST_S = 45

#: Dollars for a million tokens read and written, and for a minute of audio.
TOKEN_PRICES = {"gpt-5.5-2026-04-23": ("5", "30")}
AUDIO_PRICES = {"gpt-4o-mini-transcribe": "0.003", "gpt-4o-transcribe": "0.006", "whisper-1": "0.006"}
CACHED_RATE, AUDIO_BITS_PER_S = "0.1", 16000

# Names that events, appointments and medications are shown by, what a line about an event tells of its details, and lengths of excerpts.
KIND_NAMES = {"symptom": "Symptom", "appointment": "Appointment", "medication": "Medication", "note": "Note"}
APPOINTMENT_NAMES = {"gp": "GP", "specialist": "Specialist", "hospital": "Hospital", "test": "Test", "therapy": "Therapy", "other": "Other"}
ACTION_NAMES = {
    "started": "Started", "stopped": "Stopped", "changed": "Dose changed", "missed": "Dose missed", "refilled": "Prescription collected", "side_effect": "Possible side effect", "other": "Other",
}
DETAIL_KEYS = ("status", "provider_name", "location", "outcome", "dose_text", "action", "severity")
UNINFORMATIVE = ("", "unknown", "other")
EXCERPT_CHARS, LINE_BODY_CHARS = 300, 220
AUDIO_BYTES = 20 * 1024 * 1024
AUDIO_TYPES = ("audio", "voice", "ptt")
#: What a model answers with first where two records aren't one event.
DIFFERENT = "DIFFERENT EVENT"

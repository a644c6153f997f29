"""Fixed values of the domain: they must be just these for right results."""

# White space at the ends of texts and between words: ASCII's, and Unicode's with the byte order mark.
WHITE = "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
# Determinations in order of precedence: the first that any filing has is the ruling.
PRECEDENCE = ["CONTRADICTED", "SYNTHETIC", "ANOMALOUS", "CONTESTED", "REQUIRES VERIFICATION", "INSUFFICIENT", "CONSISTENT", "SUPPORTED", "CLEAR"]
# Tones: all determinations in neither set are adverse.
CLEAR = ["SUPPORTED", "CONSISTENT", "CLEAR"]
OPEN = ["REQUIRES VERIFICATION", "INSUFFICIENT"]
# Desks in order: those that file on an artifact, and their weights and determinations.
DESKS = [("text", "Text", 24), ("image", "Image", 16), ("audio", "Audio", 18), ("video", "Video", 21), ("fact-check", "Fact-check", 21)]
FILED = {"text": "REQUIRES VERIFICATION", "image": "SYNTHETIC", "audio": "SYNTHETIC", "video": "SYNTHETIC", "fact-check": "CONTRADICTED"}
# Headlines by ruling; all other rulings have the last one.
HEADLINES = {
    "CONTRADICTED": "Fabricated, and assembled deliberately",
    "SYNTHETIC": "Machine-made, and presented as a record",
    "ANOMALOUS": "Altered somewhere between capture and here",
    "CONTESTED": "Contested exactly where it matters",
    "REQUIRES VERIFICATION": "Unsupported, and not yet publishable",
    "INSUFFICIENT": "Too little to rule on either way",
}
HEADLINE = "The record stands as filed"
# Date of the issue, printed in ledgers.
ISSUE = "22 Aug 2026"
# Artifact kinds and the desks that they open.
ROSTER = {"copy": ["text", "fact-check"], "frame": ["image"], "recording": ["audio"], "footage": ["video", "audio"]}
# What the bench calls the kinds.
KIND_LABELS = {"copy": "Copy", "frame": "Frame", "recording": "Recording", "footage": "Footage"}
# Presentation tokens of tones: text, rule, border.
TONE_TOKENS = {
    "clear": ("text-trust-green", "bg-trust-green", "border-trust-green"),
    "open": ("text-gold-ink", "bg-gold-foil", "border-gold-foil"),
    "adverse": ("text-secondary", "bg-secondary", "border-secondary"),
}
# Badges by upper-case status; others are unsettled.
BADGES = {"VERIFIED": "verified", "UNDER REVIEW": "review", "CONTESTED": "contested", "ERROR": "error"}
# Determinations of the notes on a text's first sentences, used in turn.
NOTE_DETERMINATIONS = ["REQUIRES VERIFICATION", "SUPPORTED", "CONTESTED", "CONTRADICTED"]
COUNT_WORDS = ["No", "One", "Two", "Three", "Four", "Five"]
# FNV-1a, 32 bits; the step and masks of the counter-based generator; the envelope's shape.
FNV_OFFSET, FNV_PRIME, MASK = 2166136261, 16777619, 4294967295
STEP = 1831565813
DRIFT, LOW, HIGH, MIDDLE, TAPER = 0.55, 0.12, 1.0, 0.5, 0.35
# A recording: its seconds, samples and flagged spans (ref, start, end) as fractions.
RECORDING_SECONDS, SAMPLES = 168, 160
FLAGGED_SPANS = [(1, 0.52, 0.63), (2, 0.78, 0.86)]
# Footage: its seconds, frames and flagged frames by index.
FOOTAGE_SECONDS, FRAMES = 105, 12
FLAGGED_FRAMES = {6: 1, 9: 2}
# Determinations that the image, audio, video and claim desks note, in order of their marks; confidence of each desk.
MARKED = {
    "image": ["ANOMALOUS", "CONTESTED", "SYNTHETIC"],
    "audio": ["SYNTHETIC", "ANOMALOUS", "CONSISTENT"],
    "video": ["SYNTHETIC", "ANOMALOUS", "CONSISTENT"],
    "fact-check": ["CONTRADICTED", "INSUFFICIENT", "CONTESTED"],
}
CONFIDENCE = {"text": "92%", "image": "87%", "audio": "91%", "video": "88%", "fact-check": "94%"}
# A recording's transcript: speaker, ref of the flag or none; footage's scenes: span, determination.
TRANSCRIPT = [("Speaker 01", None), ("Speaker 02", None), ("Speaker 01", 1), ("Speaker 01", 2)]
SCENES = [(0.34, "CONSISTENT"), (0.22, "CONSISTENT"), (0.29, "ANOMALOUS"), (0.15, "CONSISTENT")]
# Regions on a frame: ref, x, y, w, h in hundredths; channels of a frame: label, weight.
REGIONS = [(1, 18, 22, 26, 30), (2, 58, 14, 22, 22), (3, 40, 62, 34, 24)]
# Signals of a text besides those that are measured: label, reading, weight; channels of a frame likewise.
TEXT_SIGNALS = [("Source attribution", "SPARSE", 0.28), ("Register consistency", "STABLE", 0.82)]
SHIFT_WEIGHT = 0.45
CHANNELS = [("Red residual", "0.41", 0.41), ("Green residual", "0.36", 0.36), ("Blue residual", "0.78", 0.78), ("Luminance noise", "UNEVEN", 0.66)]
# Signals of a decision besides agreement and confidence.
DECISION_SIGNALS = [("Evidence strength", "91%", 0.91), ("Signal consistency", "89%", 0.89)]
# Exhibits on a claim: source, published, relevance, reliability, determination.
EXHIBITS = [
    ("Global Ledger DB", "12 May 2024", "HIGH", "VERIFIED", "CONTRADICTED"),
    ("Primary Source Archives", "10 May 2024", "MEDIUM", "HIGH", "INSUFFICIENT"),
    ("Historical Event Record", "20 Nov 2023", "HIGH", "VERIFIED", "CONTESTED"),
    ("Verified Witness Statements", "14 May 2024", "LOW", "MEDIUM", "SUPPORTED"),
    ("Official Register, Second Series", "03 Jun 2024", "MEDIUM", "VERIFIED", "CONTRADICTED"),
]
# The verdict of each desk: determination and headline.
VERDICTS = {
    "text": ("REQUIRES VERIFICATION", "Two claims cannot be sourced"),
    "image": ("SYNTHETIC", "The frame was generated, not photographed"),
    "audio": ("SYNTHETIC", "Two passages were not spoken in the room"),
    "video": ("SYNTHETIC", "One scene carries a face substitution"),
    "fact-check": ("CONTRADICTED", "The central figure is wrong by a factor of three"),
}

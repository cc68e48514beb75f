"""The package's own templates: the fixed dimension a corpus is built from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# (id, lang, difficulty, source, noisy, text); every text is original to this package.
TEMPLATES = (
    ("en-kyc", "en", "easy", "template", False, "KYC update: Aadhaar {aadhaar}, PAN {pan}, mobile {phone:intl}."),
    ("en-refund", "en", "easy", "template", False, "Please send the refund to {upi:name} or to card {card:spaced}."),
    ("en-branch", "en", "easy", "template", False, "{name} banks at {ifsc} and files under {gstin}."),
    ("en-travel", "en", "medium", "template", False, "Passenger {name}, passport {passport}, born {dob:long}, reachable on {phone:split}."),
    ("en-vehicle", "en", "medium", "template", False, "Vehicle {vehicle:spaced} belongs to {name:upper}; voter card {voter}."),
    ("en-json", "en", "hard", "template", False, '{{"pan": "{pan:lower}", "vid": "{vid:hyphen}"}}'),
    ("en-mail", "en", "medium", "template", False, "Write to {email:title} and copy {other_name}, who lives at {address}."),
    ("en-lower", "en", "hard", "template", False, "gst {gstin:lower} ifsc {ifsc:lower} call {phone:zero}"),
    ("en-noisy", "en", "hard", "template", True, "Scanned form, please verify: holder {name}; Aadhaar No. {aadhaar:plain}, old card {card:hyphen}. Sealed, office copy."),
    ("hl-kyc", "hi-Latn", "easy", "template", False, "Mera naam {name} hai, PAN {pan} aur Aadhaar {aadhaar:hyphen} hai."),
    ("hl-pay", "hi-Latn", "medium", "template", False, "Paise {upi:phone} par bhej do, ya {phone:plain} par call karo."),
    ("hl-noisy", "hi-Latn", "hard", "template", True, "Bhai, gaadi {vehicle:plain} ki RC bhejo; mail {email} par, ok."),
    ("hd-kyc", "hi-Deva", "easy", "template", False, "मेरा नाम {name} है और मेरा पैन {pan} है।"),
    ("hd-home", "hi-Deva", "medium", "template", False, "पता: {address}। फ़ोन {phone:intl_hyphen}, जन्म {dob}।"),
    ("hd-card", "hi-Deva", "hard", "template", False, "कार्ड {card:plain} और आधार {vid:spaced} दोनों {name:deva_first} के हैं।"),
    ("mx-kyc", "mixed", "medium", "template", False, "Sir, मेरा passport {passport} है, voter ID {voter}, DOB {dob:iso}."),
    ("mx-bank", "mixed", "hard", "template", False, "Account holder {name:deva}, IFSC {ifsc}, address {address:deva}"),
    ("en-empty", "en", "easy", "template", False, "The meeting moved to the next quarter; nothing else changed."),
    ("no-aadhaar", "en", "hard", "template", False, "Tracking number {decoy_aadhaar} left the warehouse."),
    ("no-card", "en", "hard", "template", False, "Batch {decoy_card} failed the scan."),
    ("no-pan", "en", "hard", "template", False, "Part code {decoy_pan} is out of stock."),
    ("no-pnr", "en", "medium", "template", False, "PNR {decoy_pnr} is confirmed, coach B2."),
    ("no-date", "en", "medium", "template", False, "The fair opens on {decoy_date}."),
    ("no-place", "en", "medium", "template", False, "Meet me at {decoy_place} after lunch."),
    ("no-passport", "en", "hard", "template", False, "Circular {decoy_passport} replaces the older one."),
    ("no-gstin", "en", "hard", "template", False, "Licence {decoy_gstin} is a sample from the manual."),
    ("no-ifsc", "hi-Latn", "hard", "template", False, "Error code {decoy_ifsc} aa raha hai."),
    ("no-handle", "mixed", "medium", "template", False, "Follow {decoy_handle} फॉर updates"),
    ("no-account", "en", "medium", "template", False, "Cron mail goes to {decoy_service_account} every night."),
    ("ff-letter", "en", "medium", "handwritten", False, "Dear {=PERSON_NAME:Kamala Rane}, your number {=PHONE:98200 12345} is on file."),
    ("ff-note", "hi-Deva", "medium", "llm", False, "{=PERSON_NAME:गौरी शेट्टी} का पैन {=PAN:ABCPS1234K} मिल गया।"),
    ("ff-sign", "en", "hard", "handwritten", False, "The board outside says {!PERSON_NAME:Tagore Theatre}."),
)
SCHEMA = "template_id string, lang string, difficulty string, source string, noisy boolean, text string"


def builtin(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, SCHEMA)

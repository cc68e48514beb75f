"""Table contracts as Spark DDL. Offsets are Unicode code points, end exclusive."""

SPAN = "struct<start:int,end:int,entity:string>"
LABELLED_SPAN = "struct<start:int,end:int,label:string,value:string>"
TOOL_ENTITY = "struct<start:int,end:int,label:string,score:double>"
PREDICTED = "struct<start:int,end:int,mapped:string,unmapped:string>"

SAMPLES = (
    "id string, text string, "
    f"labels struct<kind:string,spans:array<{SPAN}>,decoy:string>, "
    "lang string, difficulty string, source string, generator_version string"
)
MANIFEST = (
    "version string, seed int, per_template int, generator_version string, sample_count long, fingerprint string"
)
DETECTIONS = (
    f"sample_id string, status string, predicted array<{PREDICTED}>, elapsed_ns long, wall_ns long, message string"
)
RUNS = (
    "run_id string, started_at string, harness_version string, "
    "tool struct<name:string,version:string,commit:string,config:string>, "
    "hardware struct<os:string,arch:string,cpu:string,cores:int,memory_mb:int>, "
    "suite struct<kind:string,dataset_version:string,dataset_fingerprint:string,driver:string>"
)
RESTORES = (
    "scenario_id string, outcome struct<status:string,failures:array<struct<check:string,detail:string>>,"
    "upstream_excerpt:string,client_excerpt:string,reason:string>"
)
SEGMENT = "struct<text:string,slot:int,from:int,to:int,mangle:string>"
TURN = (
    f"struct<input:struct<kind:string,segments:array<{SEGMENT}>,call_id:string>,"
    f"reply:struct<kind:string,chunks:array<array<{SEGMENT}>>,call_id:string,name:string,status:int,body:string>>"
)
SCENARIOS = (
    "id string, category string, description string, api string, stream boolean, pii array<string>, "
    "tools array<struct<name:string,description:string,parameters:string>>, "
    f"turns array<{TURN}>, checks array<string>"
)
TOOL_CALL = "struct<id:string,name:string,arguments:string>"
OBSERVATIONS = (
    "conv_id string, turn int, kind string, text string, "
    f"tool_calls array<{TOOL_CALL}>, message string, http_status int"
)

# The closed vocabularies of the data model.
STRUCTURAL_ENTITIES = (
    "AADHAAR", "AADHAAR_VID", "PAN", "GSTIN", "IFSC", "UPI_ID", "PHONE", "EMAIL",
    "PAYMENT_CARD", "PASSPORT", "VOTER_ID", "VEHICLE_REGISTRATION",
)
FREE_ENTITIES = ("PERSON_NAME", "ADDRESS", "DATE_OF_BIRTH")
ENTITIES = STRUCTURAL_ENTITIES + FREE_ENTITIES
LANGS = ("en", "hi-Latn", "hi-Deva", "mixed")
DIFFICULTIES = ("easy", "medium", "hard")
SOURCES = ("template", "llm", "handwritten")
CHECKS = (
    "no_leak_upstream", "restored_exact", "no_placeholder_fragment",
    "placeholder_stable_across_turns", "json_valid", "fails_closed",
)
CATEGORIES = (
    "basic", "streaming_split", "tool_calls", "multi_turn", "placeholder_mangling",
    "repeats_adjacency", "unicode", "structured_output", "failure_behaviour",
)

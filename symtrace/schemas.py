"""Schemas of the persistent relations, as Spark DDL."""

FUNCTIONS = "id LONG, name STRING, file_path STRING, line_start INT, line_end INT, hash STRING, is_def INT"
STRINGS = "id LONG, content STRING, length INT"
FUNCTION_STRING_MAP = "function_id LONG, string_id LONG, usage_count LONG"
SOURCE_CALL_GRAPH = "caller_id LONG, callee_id LONG, call_line INT"
BINARY_FUNCTIONS = "id LONG, address STRING, name STRING, size LONG, is_library INT"
BINARY_STRINGS = "id LONG, address STRING, content STRING, length INT"
BINARY_REFS = "func_id LONG, string_id LONG, ref_addr STRING, ref_type STRING"
BINARY_CALL_GRAPH = "caller_id LONG, callee_id LONG, call_addr STRING"
EXTRACT = (
    "program STRING, image_base STRING, "
    "functions ARRAY<STRUCT<address:STRING,name:STRING,size:LONG,is_library:INT,entry_offset:LONG>>, "
    "strings ARRAY<STRUCT<address:STRING,content:STRING,length:INT,addr_offset:LONG>>, "
    "call_graph ARRAY<STRUCT<caller:STRING,callee:STRING,call_addr:STRING>>, "
    "func_string_refs ARRAY<STRUCT<func_addr:STRING,string_addr:STRING,ref_addr:STRING>>"
)
CONFIRMED = "bin_id LONG, src_id LONG, confidence DOUBLE, method STRING, seq LONG"
CANDIDATES = "bin_id LONG, src_id LONG, score DOUBLE, method STRING, seq LONG"
MAPPING_RESULTS = (
    "bin_func_id LONG, bin_address STRING, src_func_id LONG, src_func_name STRING, src_file_path STRING, confidence DOUBLE, "
    "method STRING, ref_type STRING, shared_strings INT, call_similarity DOUBLE, timestamp TIMESTAMP"
)
MAPPING_CANDIDATES = "bin_func_id LONG, src_func_id LONG, score DOUBLE, method STRING"
MAPPING_LOG = "phase STRING, bin_func_id LONG, src_func_id LONG, score DOUBLE, reason STRING, timestamp TIMESTAMP"
STATISTICS = "phase STRING, confirmed_count LONG, candidate_count LONG, avg_confidence DOUBLE, execution_time DOUBLE"

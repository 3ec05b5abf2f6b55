"""Declared schemas of the stored tables; NULL stands for a field that an older row lacks."""

from pyspark.sql import types as T

CHUNKS = "id string, embedding array<float>, manual_id string, type string, content string, page int, path string, figure_role string, parent_path string, width int, height int, kind string, render_markdown string, ref string, part_numbers array<string>"
MEMORY = "id string, embedding array<float>, machine_id string, manual_id string, session_id string, symptom string, root_cause string, actions string, method string, parts_replaced string, engineer string, summary string, operator_fix string, timestamp string"
MANUALS = "manual_id string, filename string, url string, created_at string"
MACHINES = "machine_id string, name string, location string, manual_id string"
SESSIONS = "id bigint, machine_id string, intent string, title string, created_at string, updated_at string, resolved_at string, resolution string"
MESSAGES = "id bigint, session_id bigint, role string, content string, type string, step_data string, images string, attachments string, timestamp string"
PARTS_ROW = "struct<ref:string,part_number:string,description:string,remarks:string,qty:string,check:string>"
WORDS = "page int, x0 double, y0 double, x1 double, y1 double, text string, conf double"

TYPES = ("text", "image", "table", "part")
KINDS = ("diagram", "schematic", "chart", "flowchart", "exploded_view", "photo", "table", "part")


def struct(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)

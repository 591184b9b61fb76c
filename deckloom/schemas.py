"""Schemas of the tables that the operators read and write; every nested project entity has one table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUN = (
    "run_id string, project_id string, started_at timestamp, duration_s double, status string, message string, "
    "stages array<struct<stage:string,duration_s:double,status:string,detail:string>>, "
    "degradations array<struct<what:string,reason:string>>, "
    "llm_calls array<struct<provider:string,model:string,input_tokens:bigint,output_tokens:bigint,"
    "cache_read_tokens:bigint,cache_write_tokens:bigint,duration_s:double>>, "
    "flags map<string,boolean>, "
    "quality struct<score:double,dimensions:array<struct<name:string,score:double,weight:double,detail:string>>,"
    "errors:int,warnings:int>, error string"
)
LEDGER = (
    "project_id string, seq bigint, kind string, name string, detail string, skill string, parent bigint, "
    "tools array<string>, status string, duration_s double, at timestamp, "
    "artifacts array<struct<label:string,kind:string,path:string,text:string,scene_id:string,page:int>>, "
    "run_id string, covers array<string>"
)
TURN = "project_id string, turn_no int, speaker string, text string, action string, ok boolean, at timestamp"
ELEMENT = (
    "element_id:string,kind:string,text:string,bbox:struct<x:double,y:double,w:double,h:double>,level:int,label:string,"
    "importance:double,asset_path:string,font_size:double"
)
PAGE = (
    "page_index:int,page_type:string,title:string,speaker_notes:string,image_path:string,width:double,height:double,"
    f"summary:string,key_points:array<string>,elements:array<struct<{ELEMENT}>>"
)
SEGMENT = "segment_id:string,text:string,element_refs:array<string>,emphasis:boolean,start:double,end:double"
ACTION = "at:double,type:string,target:string,effect:string,duration:double,params:map<string,string>"
SCENE = (
    "scene_id:string,source_page:int,title:string,narration:string,duration:double,"
    "visual:struct<type:string,asset:string,source_page:int>,"
    "audio:struct<path:string,duration:double,voice:string,provider:string,text_hash:string>,"
    f"segments:array<struct<{SEGMENT}>>,actions:array<struct<{ACTION}>>"
)
PROJECT = (
    "project_id string, created_at timestamp, updated_at string, status string, "
    "source struct<type:string,file:string,path:string,page_count:int>, "
    "intent struct<audience:string,style:string,tone:string,language:string,duration:int,emphasis_pages:array<int>,"
    "skip_pages:array<int>,instructions:string,voice:string,speech_rate:double,pronunciation:map<string,string>>, "
    f"document struct<title:string,topic:string,summary:string,pages:array<struct<{PAGE}>>>, "
    f"scenes array<struct<{SCENE}>>, "
    "render struct<renderer:string,status:string,output_path:string,rendered_scenes:map<string,string>,"
    "scene_clips:map<string,string>>"
)
SCHEMAS = {"run": RUN, "ledger": LEDGER, "turn": TURN, "project": PROJECT}


def leaves(schema: T.StructType, prefix: str = "") -> list[tuple[str, str]]:
    """``(path, type)`` of each field that isn't a struct, in order; what lists and maps hold isn't taken apart."""
    found = []
    for field in schema.fields:
        path = prefix + field.name
        found += leaves(field.dataType, f"{path}.") if isinstance(field.dataType, T.StructType) else [(path, field.dataType.typeName())]
    return found


def filled_fields(rows: DataFrame, name: str) -> DataFrame:
    """VW-8: ``field, type, filled``: each field of a published schema and the number of rows in which it isn't null."""
    fields = leaves(T._parse_datatype_string(SCHEMAS[name]))
    counts = rows.agg(F.array(*[F.struct(F.lit(p).alias("field"), F.lit(t).alias("type"), F.count(F.col(p)).alias("filled")) for p, t in fields]).alias("x"))
    return counts.select(F.explode("x").alias("x")).select("x.*")


def export_schemas() -> dict[str, str]:
    """Every schema as the JSON that Spark itself reads back."""
    return {name: T._parse_datatype_string(ddl).json() for name, ddl in SCHEMAS.items()}

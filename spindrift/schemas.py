"""Schemas of the stored documents and tables."""

from __future__ import annotations

#: Stages in their order, a fixed value.
STAGES = ("s1_download", "s2_transcribe", "s3_script", "s4_render")

COST = "stage string, provider string, model string, unit string, quantity double, unit_price_usd double, usd double, estimated boolean, note string"
POINT = "label string, value double, unit string"
AUDIO_INFO = "video_id string, title string, channel string, url string, original_duration_sec double, processed_duration_sec double, audio_path string, preprocessing map<string,string>"
SEGMENT = "start double, end double, text string"
TRANSCRIPT = f"video_id string, language string, provider string, model string, duration_sec double, segments array<struct<{SEGMENT.replace(' ', ':').replace(',:', ',')}>>"
_POINT = "struct<label:string,value:double,unit:string>"
TOPIC = f"id int, start double, end double, topic string, summary string, key_points array<string>, data_points array<{_POINT}>, has_chart_data boolean, hook_score int, selected boolean, skip_reason string"
_CHART = f"struct<type:string,title:string,y_label:string,series:array<struct<name:string,points:array<{_POINT}>>>>"
CLIP = f"segment_id int, title string, hook string, lines array<struct<text:string,emphasis:boolean,visual:string>>, chart {_CHART}, attribution string, est_seconds double, ai_shot string, plagiarism_overlap double, plagiarism_lcs int, plagiarism_ok boolean, rewrite_attempts int, numbers_unverified array<string>"


def nested(ddl: str) -> str:
    """A row schema as the type of a struct."""
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).simpleString()


_COST = "struct<stage:string,provider:string,model:string,unit:string,quantity:double,unit_price_usd:double,usd:double,estimated:boolean,note:string>"
STAGE_RECORD = f"struct<config_hash:string,config:map<string,string>,outputs:map<string,string>,meta:map<string,string>,costs:array<{_COST}>,finished_at:string>"
RUN = "struct<started:double,dry_run:boolean,force:boolean,stages_run:array<string>,stages_cached:array<string>,usd:double>"
MANIFEST = f"video_id string, url string, created string, updated string, stages map<string,{STAGE_RECORD}>, runs array<{RUN}>"
RENDER = "segment_id int, title string, video_path string, duration_sec double, chart_path string, ai_shot_path string, ai_shot_paths array<string>, ai_shot_provider string, ai_shot_seconds double, ai_shot_usd double, broll_paths array<string>, broll_provider string"

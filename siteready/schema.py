"""Explicit schemas of the records; sources never infer."""

from __future__ import annotations

from pyspark.sql import types as T


def ddl(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)


RUN = ("run_id string, kind string, status string, created_at string, finished_at string, site struct<host:string,start_url:string,final_url:string>, "
       "settings struct<profiles:array<string>,stages:array<string>,locale:string>, pages array<struct<page_id:string,stage:string,profile:string,url:string,final_url:string,"
       "status_code:int,repeat_of:string,classification:struct<type:string,confidence:double,signals:array<string>>,"
       "vitals:struct<ttfb:double,fcp:double,lcp:double,cls:double,tbt_approx:double,loaf_count:int>,network:struct<requests:int,bytes_transfer:bigint>,"
       "audit:struct<prices:array<struct<text:string,value:double,currency:string,kind:string>>,snippets:array<struct<snippet_id:string,kind:string,text:string>>,"
       "overlays:array<struct<kind:string,coverage:double,modal:boolean>>>>>, "
       "observations array<struct<kpi_id:string,value:string,unit:string,source:string,page_id:string,profile:string,stage:string,assessed:boolean,reason:string>>, "
       "not_assessable array<struct<stage:string,profile:string,kpi_id:string,reason:string>>, "
       "judgments struct<tasks:array<struct<task_id:string,rubric_id:string,kpi_id:string,page_id:string,samples_required:int>>,"
       "verdicts:array<struct<task_id:string,judge_id:string,model:string,label:string,confidence:double>>,"
       "final:array<struct<task_id:string,kpi_id:string,label:string,agreement:double,samples:int,confidence:double>>>")
STEP = ("run_id string, step int, t_wall timestamp, operation string, label string, node bigint, role string, source string, url_before string, url_after string, "
        "page_changed boolean, execution_ms double, settle_ms double, settle_reason string, decision_latency_ms double, "
        "since struct<available:boolean,first_response_ms:double,first_request_ms:double,mutations:int,mutations_total:int,navigations:int,requests:int,shifts_post_input:double,event_timing_max_ms:double>, "
        "flags struct<stale:boolean,guard_blocked:boolean,new_tab:boolean,new_document:boolean,external_nav:boolean,navigation_error:boolean,state_changed:boolean,follows_timeout:boolean>")
EVENT = "run_id string, page_id string, idx bigint, method string, params string"

"""Schemas of the engine's tables; sources never infer them."""

RANGE = "struct<start:double,end:double>"
CONCEPT = f"struct<name:string,aliases:array<string>,type:string,definition:string,importance:string,timestamp_range:{RANGE}>"
RELATIONSHIP = "struct<from_concept:string,to_concept:string,type:string,evidence:string>"
EXAMPLE = "struct<description:string,illustrates:string,timestamp:double>"
QUOTE = "struct<text:string,timestamp:double,relevance:string>"
SENTENCE = "struct<text:string,start:double,end:double,confidence:double>"

WORDS = "video_id string, pos long, text string, start double, end double, confidence double"
SENTENCES = "video_id string, sent_idx long, text string, start double, end double, confidence double"
SEGMENTS = f"segment_id string, video_id string, seg_no int, title string, start double, end double, transcript string, sentences array<{SENTENCE}>"
MENTIONS = f"video_id string, seg_no int, segment_id string, pos int, name string, aliases array<string>, type string, definition string, importance string, timestamp_range {RANGE}"
RELATIONSHIPS = "video_id string, seg_no int, segment_id string, pos int, from_concept string, to_concept string, type string, evidence string"
RESULT = (
    "video_id string, title string, source string, duration double, "
    "segments array<struct<id:string,video_id:string,title:string,start:double,end:double,transcript:string>>, "
    f"knowledge_units array<struct<segment_id:string,segment_title:string,timestamp_range:{RANGE},concepts:array<{CONCEPT}>,relationships:array<{RELATIONSHIP}>,examples:array<{EXAMPLE}>,key_quotes:array<{QUOTE}>>>, "
    f"concepts array<{CONCEPT}>"
)

"""Schemas of the fused model."""

JOB = "struct<title:string,company:string,start_date:string,end_date:string,description:string,location:string>"
STUDY = "struct<institution:string,degree:string,field_of_study:string,start_date:string,end_date:string,gpa:double>"
LINK = "struct<url:string,label:string>"
#: One row for each entity and source; ``seq`` orders several rows of one source (the first counts).
SOURCE_RECORD = (
    "fusion_id string, source string, seq long, candidate_id string, full_name string, emails array<string>, phones array<string>, location string, headline string, "
    f"skills array<string>, links array<{LINK}>, experience array<{JOB}>, education array<{STUDY}>, years_experience string"
)

"""Declared schemas of the data this library reads and writes, as DDL."""

from __future__ import annotations

#: Raw questions whose context is [[title, [sentence, ...]], ...]: such arrays mix types, so they come as text.
PAIRED_QUESTION = "_id string, question string, answer string, context string, supporting_facts string, level string"
#: Raw multi-hop questions with a list of paragraphs.
PARAGRAPH_QUESTION = (
    "id string, question string, answer string, answerable boolean, paragraphs array<struct<idx:int,title:string,paragraph_text:string>>, "
    "question_decomposition array<struct<paragraph_support_idx:int>>"
)
#: Raw reading-comprehension articles.
ARTICLE_QUESTION = "data array<struct<paragraphs:array<struct<context:string,qas:array<struct<question:string,is_impossible:boolean,answers:array<struct<text:string>>>>>>>>"
CORPUS = "doc_id bigint, text string"
QUESTION = "id string, query string, outputs array<string>, context array<bigint>, more_context array<bigint>, supporting_facts array<bigint>"
FLAT_QUESTION = "id string, query string, outputs array<string>, context string, level string"
SAMPLE = "index bigint, source_index bigint, input string, context string, answers array<string>, length int, distract_questions array<string>"
TRAJECTORY = "text string, extracted_answer string, sub_em int, em int, f1 double, is_correct int"
RECORD = f"index bigint, source_index bigint, input string, context string, answers array<string>, length int, model string, trajectories array<struct<{TRAJECTORY.replace(' ', ':').replace(',:', ',')}>>, num_correct int, pass_rate double"
MESSAGES = "messages array<struct<role:string,content:string>>"
CHAT_ROW = f"{MESSAGES}, is_correct int, sub_em int, em int, f1 double, extracted_answer string, answers array<string>, source_index bigint, dataset string, length int, model string"
RL_ROW = "question string, context string, answers array<string>, answer string, messages array<struct<role:string,content:string>>"
JUDGED = "question string, judge_results array<struct<reason:string,is_correct:int>>, avg_acc double, any_correct boolean, pred_list array<string>, gold array<string>"
STEP_LOG = "input string, score double"
BIN_ACCURACY = "bin string, total bigint, correct bigint, accuracy double"
METRIC = "run string, step bigint, key string, value double"
MANIFEST = "dataset string, length int, stage string, samples bigint, file string, updated_at timestamp"
REASONED = "index bigint, input string, context string, answer string, reasonings array<string>"

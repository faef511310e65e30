"""corpusloom: long-context question-answering data, made, scored and analysed with Spark."""

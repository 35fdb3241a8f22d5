"""Clinical text and EHR preparation, correction and evaluation on Spark DataFrames."""

"""Training-data operations on documents, vectors and conversations.

Every operator takes DataFrames and returns a DataFrame that holds the row's id and the columns it computes, and
never the other input columns; those may therefore have any name. Inputs are read by the names given as parameters.
"""

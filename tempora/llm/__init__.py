"""Training-data operators: archives, tokens, fingerprints, quality, search, mixing, licences, chat.

Nothing outside this package imports it.  Each module holds one operator with a
general interface; ``queries`` registers the thin ``opN_*`` queries over it.
Every function takes and returns DataFrames and keeps the work on executors.
"""

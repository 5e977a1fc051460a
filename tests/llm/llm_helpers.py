"""What the tests of the text operators share."""

import os

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def plain_words(text):
    return (text or "").encode().split()  # bytes split at ASCII white space only

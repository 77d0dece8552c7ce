"""Rating labels and what they are worth."""

# The usual rating labels.
LABEL_VALUES = {
    "favorite": 4.0,
    "like": 2.0,
    "dislike": -2.0,
    "neutral": 0.1,
    "willsee": 0.5,
    "wontsee": -0.5,
}

# The three-way labels.
THREE_WAY_VALUES = {
    "like": 2.0,
    "dislike": -2.0,
    "dontknow": 0.0,
}

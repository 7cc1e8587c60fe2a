"""Declared schemas of the tables the library reads and writes."""

from pyspark.sql import types as T

_REF = T.StructType([T.StructField("id", T.LongType()), T.StructField("type", T.StringType())])


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


TWEETS = _struct(
    tweet_id=T.LongType(),
    text=T.StringType(),
    user_id=T.LongType(),
    timestamp=T.TimestampType(),
    tweet_type=T.StringType(),
    like_count=T.LongType(),
    reply_count=T.LongType(),
    retweet_count=T.LongType(),
    quote_count=T.LongType(),
    device=T.StringType(),
    lang=T.StringType(),
    topics_ids=T.ArrayType(T.StringType()),
    topics=T.ArrayType(T.StringType()),
    referenced_tweets=T.ArrayType(_REF),
)

USERS = _struct(
    user_id=T.LongType(),
    name=T.StringType(),
    username=T.StringType(),
    followers=T.LongType(),
    following=T.LongType(),
    tweet_count=T.LongType(),
    verified=T.BooleanType(),
    created_at=T.TimestampType(),
)

FOLLOWS = _struct(account_id=T.LongType(), follower_id=T.LongType())

_API_USER = _struct(
    id=T.StringType(),
    name=T.StringType(),
    username=T.StringType(),
    verified=T.BooleanType(),
    created_at=T.StringType(),
    public_metrics=_struct(
        followers_count=T.LongType(), following_count=T.LongType(), tweet_count=T.LongType()
    ),
)

_API_TWEET = _struct(
    id=T.StringType(),
    text=T.StringType(),
    author_id=T.StringType(),
    created_at=T.StringType(),
    source=T.StringType(),
    lang=T.StringType(),
    referenced_tweets=T.ArrayType(_struct(id=T.StringType(), type=T.StringType())),
    public_metrics=_struct(
        like_count=T.LongType(),
        reply_count=T.LongType(),
        retweet_count=T.LongType(),
        quote_count=T.LongType(),
    ),
    context_annotations=T.ArrayType(
        _struct(domain=_struct(id=T.StringType(), name=T.StringType()))
    ),
)

TWEET_PAGE = _struct(
    data=T.ArrayType(_API_TWEET), includes=_struct(users=T.ArrayType(_API_USER))
)
USER_PAGE = _struct(data=T.ArrayType(_API_USER))

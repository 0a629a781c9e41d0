from alertlift.functions.normal import normal_cdf, z_score_of
from alertlift.functions.scalar import cap_at, hash_bucket, nan_to_null, r6, settle

__all__ = ["cap_at", "hash_bucket", "nan_to_null", "normal_cdf", "r6", "settle", "z_score_of"]

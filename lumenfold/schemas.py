"""Explicit schemas, as DDL, of the logical tables and of the files they come from."""

from __future__ import annotations

from pyspark.sql import types as T


SCENE = "subset STRING, scene STRING, split STRING, path STRING, num_frames INT, num_points INT, image_hw ARRAY<INT>, has_depth BOOLEAN, num_depth INT"
SCENE_INDEX = f"config MAP<STRING,STRING>, counts MAP<STRING,BIGINT>, num_train BIGINT, num_val BIGINT, scenes ARRAY<STRUCT<{SCENE.replace(' STRING', ': STRING').replace(' INT', ': INT').replace(' ARRAY', ': ARRAY').replace(' BOOLEAN', ': BOOLEAN')}>>, depth STRUCT<repo: STRING, root: STRING, counts: MAP<STRING,BIGINT>>"
FAILURE = "subset STRING, scene STRING, status STRING, reason STRING, detail STRING"
CLUSTERS = "method STRING, threshold DOUBLE, resolution DOUBLE, n_images BIGINT, num_scenes BIGINT, clusters ARRAY<STRUCT<cluster: BIGINT, size: BIGINT, cohesion: DOUBLE, scenes: ARRAY<STRUCT<subset: STRING, scene: STRING, split: STRING, typicality: DOUBLE>>>>"
EVAL_WINDOW = T.StructType(
    [T.StructField("scene_id", T.StringType()), T.StructField("repeat", T.IntegerType()), T.StructField("dense_depth", T.BooleanType())]
    + [T.StructField(n, T.DoubleType()) for n in "scene_scale loss loss_camera loss_depth loss_point cam_trans cam_rot cam_fov depth_err depth_conf depth_valid point_err abs_rel delta_1.25 scale_ratio abs_rel_aligned delta_1.25_aligned rot_err_deg_median_window trans_err_deg_median_window".split()]
)
TRAIN_LOG = "step BIGINT, split STRING, lr DOUBLE, lr_backbone DOUBLE, steps_per_sec DOUBLE, grad_norm DOUBLE, loss DOUBLE"
DEPTH_META = "lo DOUBLE, hi DOUBLE, clipped_frac DOUBLE, out_hw ARRAY<INT>, source_hw ARRAY<INT>, frames ARRAY<STRING>"
FEATURE = "subset STRING, scene STRING, img_no INT, cls ARRAY<DOUBLE>, frame STRING, has_depth BOOLEAN"
CAMERA = "path STRING, camera_id INT, model STRING, width BIGINT, height BIGINT, params ARRAY<DOUBLE>"
IMAGE = "path STRING, image_id INT, qvec ARRAY<DOUBLE>, tvec ARRAY<DOUBLE>, camera_id INT, name STRING, n_keypoints BIGINT"
KEYPOINT = "path STRING, image_id INT, ordinal INT, x DOUBLE, y DOUBLE, point3d_id BIGINT"
POINT3D = "path STRING, point_id BIGINT, x DOUBLE, y DOUBLE, z DOUBLE, r SMALLINT, g SMALLINT, b SMALLINT, error DOUBLE, track_length INT"

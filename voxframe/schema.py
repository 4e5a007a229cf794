"""Schemas of the relations that the operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    fields = []
    kinds = {"long": T.LongType(), "double": T.DoubleType(), "string": T.StringType(),
             "int": T.IntegerType(), "bool": T.BooleanType(), "matrix": T.ArrayType(T.DoubleType())}
    for item in spec.split():
        name, kind = item.split(":")
        fields.append(T.StructField(name, kinds[kind], True))
    return T.StructType(fields)


VOXELS = _struct("volume_id:long i:long j:long k:long value:double")
LABEL_VOXELS = _struct("volume_id:long i:long j:long k:long label:long")
MASK_VOXELS = _struct("volume_id:long i:long j:long k:long")
GRIDS = _struct("volume_id:long nx:long ny:long nz:long affine:matrix unit:string "
                "qform_code:int sform_code:int dense:bool")
POINTS = _struct("volume_id:long point_id:long x:double y:double z:double")
PATCHES = _struct("volume_id:long patch_index:long z0:long z1:long y0:long y1:long x0:long x1:long")
PATCH_LABELS = _struct("volume_id:long patch_index:long i:long j:long k:long local_label:long")
COMPONENT_MAP = _struct("volume_id:long patch_index:long local_label:long global_component_id:long")
FIBRE_CENTROIDS = _struct("label:long centroid_y:double centroid_x:double")
RUN_METRICS = _struct("image:string MI_global:double NCC_global:double valid_voxels_global:long "
                      "MI_mask:double NCC_mask:double valid_voxels_mask:long registered_path:string")

VOXEL_KEY = ("volume_id", "i", "j", "k")

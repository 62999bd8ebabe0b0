"""Pixel and landmark functions: the few that columns can't express, in numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A generic face: eyes, nose, mouth corners.
FACE_MODEL = np.array([[-30.0, 35.0, 30.0], [30.0, 35.0, 30.0], [0.0, 0.0, 0.0], [-25.0, -30.0, 20.0], [25.0, -30.0, 20.0]])


def gray(image: np.ndarray) -> np.ndarray:
    """Luma of a blue-green-red image."""
    return image if image.ndim == 2 else image[..., :3].astype(np.float64) @ np.array([0.114, 0.587, 0.299])


def sharpness(image: np.ndarray) -> float:
    """Variance of the Laplacian (4-neighbour, edges mirrored without repeating them); 0 for an empty image."""
    if image is None or image.size == 0:
        return 0.0
    g = np.rint(gray(image)).astype(np.float64)
    p = np.pad(g, 1, "reflect") if min(g.shape) > 1 else np.pad(g, 1, "edge")
    lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g
    return float(lap.var())


@F.pandas_udf(T.DoubleType())
def sharpness_of(pixels: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
    """Sharpness of 8-bit gray images as row-major bytes; null pixels give 0."""
    one = lambda b, h, w: sharpness(np.frombuffer(b, np.uint8).reshape(int(h), int(w))) if b else 0.0
    return pd.Series([one(*x) for x in zip(pixels, height, width, strict=True)])


def camera(landmarks: np.ndarray, shape: tuple[int, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Focal length and centre: of the image where its (height, width) is known, else four spans around the landmarks.

    landmarks: (..., 5, 2); one length and centre for each five.
    """
    if shape is not None:
        h, w = shape[:2]
        return np.full(landmarks.shape[:-2], float(max(h, w))), np.broadcast_to([w / 2, h / 2], (*landmarks.shape[:-2], 2))
    span = np.maximum(1.0, np.ptp(landmarks, axis=-2).max(-1))
    return 4 * span, landmarks.mean(-2)


def head_poses(landmarks: np.ndarray, shape: tuple[int, int] | None = None) -> np.ndarray:
    """(n, 5, 2) finite landmarks -> (n, 3) pitch, yaw, roll in degrees, in [-90, 90); NaN where there is no solution.

    Scaled orthography by least squares starts POSIT (DeMenthon and Davis 1995), which corrects for perspective.
    """
    f, centre = camera(landmarks, shape)
    model = FACE_MODEL - FACE_MODEL[2]
    back = np.linalg.pinv(model)
    image = (landmarks - centre[:, None]) / f[:, None, None]
    depth = np.zeros((len(landmarks), 5))
    r, bad = np.zeros((len(landmarks), 3, 3)), np.zeros(len(landmarks), bool)
    for _ in range(50):
        x = back @ (image * (1 + depth)[..., None] - image[:, 2:3])  # columns: the first two rows of the rotation, scaled
        scale = np.sqrt(np.linalg.norm(x[..., 0], axis=1) * np.linalg.norm(x[..., 1], axis=1))
        bad |= ~np.isfinite(scale) | (scale < 1e-12)
        x[bad], scale[bad] = np.eye(3)[:, :2], 1.0
        u, _, v = np.linalg.svd(np.swapaxes(x, 1, 2), full_matrices=False)
        r[:, :2] = u @ v
        r[:, 2] = np.cross(r[:, 0], r[:, 1])
        new = (r[:, 2] @ model.T) * scale[:, None]
        moved, depth = np.abs(new - depth).max(initial=0), new
        if moved < 1e-10:
            break
    pitch = np.arctan2(r[:, 2, 1], r[:, 2, 2])
    yaw = np.arctan2(-r[:, 2, 0], np.hypot(r[:, 2, 1], r[:, 2, 2]))
    roll = np.arctan2(r[:, 1, 0], r[:, 0, 0])
    out = (np.degrees(np.stack([pitch, yaw, roll], 1)) + 90) % 180 - 90
    out[bad] = np.nan
    return out


def _five(landmarks) -> np.ndarray | None:
    try:
        pts = np.array([list(p) for p in landmarks], np.float64)
    except (TypeError, ValueError):
        return None
    return pts if pts.shape == (5, 2) and np.isfinite(pts).all() else None


def head_pose(landmarks, shape: tuple[int, int] | None = None) -> tuple[float, float, float] | None:
    """(pitch, yaw, roll) of five landmarks; None for any other or non-finite input."""
    pts = _five(landmarks)
    got = None if pts is None else head_poses(pts[None], shape)[0]
    return None if got is None or np.isnan(got).any() else tuple(map(float, got))


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("pitch", "yaw", "roll")]))
def head_pose_of(landmarks: pd.Series) -> pd.DataFrame:
    pts = [_five(x) for x in landmarks]
    out = np.full((len(pts), 3), np.nan)
    at = [n for n, x in enumerate(pts) if x is not None]
    if at:
        out[at] = head_poses(np.stack([pts[n] for n in at]))
    return pd.DataFrame({c: pd.Series([None if np.isnan(v) else v for v in out[:, n]], dtype=object) for n, c in enumerate(("pitch", "yaw", "roll"))})

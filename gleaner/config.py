"""Settings of the engine, checked when made."""

from __future__ import annotations

from dataclasses import dataclass, field
from math import isclose, isfinite

# The defaults that results depend on.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".avif", ".png", ".bmp", ".webp", ".tif", ".tiff")
REFERENCE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".webp", ".tif", ".tiff")
POSES = ("frontal", "left", "right", "profile")
JOB_STATES = ("PENDING", "PROCESSING", "COMPLETED", "FAILED")
OBSERVATION_TYPES = ("face_and_body", "face_only", "body_only", "empty")


@dataclass(frozen=True)
class Quality:
    """Detection confidence, size and sharpness weights, and the ranges sizes and sharpness are scaled over."""

    detection: float = 0.4
    size: float = 0.3
    sharpness: float = 0.3
    size_range: tuple[float, float] = (40.0, 120.0)
    sharpness_range: tuple[float, float] = (20.0, 150.0)


@dataclass(frozen=True)
class Config:
    face: Quality = Quality()
    body: Quality = field(default_factory=lambda: Quality(size_range=(100.0, 400.0)))
    # observation quality
    quality_face: float = 0.7
    quality_detection: float = 0.3
    # trusted anchors
    anchor_quality: float = 0.5
    anchor_confidence: float = 0.5
    anchor_size: int = 40
    anchor_yaw: float = 20.0
    # pair scores
    min_face: float = 0.55
    cross_face: float = 0.60
    cross_body: float = 0.50
    merge: float = 0.78
    cross_merge: float = 0.75
    face_weight: float = 0.65
    body_weight: float = 0.20
    quality_weight: float = 0.15
    face_only_weight: float = 0.75
    face_only_quality_weight: float = 0.25
    # clusters
    min_cluster: int = 2
    representatives: int = 3
    per_pose: int = 3
    # matching
    match: float = 0.55
    margin: float = 0.02
    # selection
    best: int = 5
    face_padding: float = 0.25
    upper_body: float = 0.6
    # association and detection
    association: float = 0.3
    detection: float = 0.4
    person_class: int = 0
    # pose
    frontal_yaw: float = 20.0
    profile_yaw: float = 55.0
    # jobs
    stale_seconds: float = 600.0
    # layout
    events_root: str = "data/events"
    output_root: str = "output"

    def __post_init__(self):
        shares = ("anchor_quality", "anchor_confidence", "merge", "cross_merge", "quality_face", "quality_detection", "face_weight", "body_weight", "quality_weight", "face_only_weight", "face_only_quality_weight", "association", "detection")
        for name in shares:
            if not (isfinite(v := getattr(self, name)) and 0 <= v <= 1):
                raise ValueError(f"{name} must lie in [0, 1]: {v}")
        for name in ("min_face", "cross_face", "cross_body", "match"):
            if not (isfinite(v := getattr(self, name)) and -1 <= v <= 1):
                raise ValueError(f"{name} must lie in [-1, 1]: {v}")
        for name in ("min_cluster", "representatives", "per_pose", "best", "anchor_size"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be 1 or more: {getattr(self, name)}")
        if not 0 <= self.anchor_yaw <= 90 or not 0 <= self.frontal_yaw < self.profile_yaw <= 90:
            raise ValueError("yaw limits must lie in [0, 90], frontal below profile")
        groups = {
            "observation quality": (self.quality_face, self.quality_detection),
            "pair score": (self.face_weight, self.body_weight, self.quality_weight),
            "face-only pair score": (self.face_only_weight, self.face_only_quality_weight),
            "face quality": (self.face.detection, self.face.size, self.face.sharpness),
            "body quality": (self.body.detection, self.body.size, self.body.sharpness),
        }
        for name, weights in groups.items():
            if not isclose(sum(weights), 1.0):
                raise ValueError(f"{name} weights must sum to 1: {weights}")
        for q in (self.face, self.body):
            if q.size_range[1] <= q.size_range[0] or q.sharpness_range[1] <= q.sharpness_range[0]:
                raise ValueError("ranges must rise")

    @property
    def edge(self) -> float:
        """The least score at which any two observations can merge."""
        return min(self.merge, self.cross_merge)


DEFAULT = Config()
